"""Exact tokenisation of whole texts with a bounded chunk cache.

A text is cut where the tokenizer itself always cuts (before a single space), each distinct
chunk is encoded once by the ``tokenizers`` library, and its ids are then looked up.  The ids
are those that the library gives for the whole text; a text whose white space would make a cut
unsafe is encoded whole.  Line ends between other characters are cut too.  ``null`` counts as the empty text, which has no tokens.
"""

from __future__ import annotations

import json
import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Distinct chunks that a worker keeps; on more it starts anew, so its memory is bounded.
CACHE_ENTRIES = 500_000

#: Punctuation that both pre-tokenizers part from a word before it.
_ENDS = frozenset('.,!?;:|')

#: Begins a piece that no space stands before.
_MARK = "\x00"
#: Marks before a space that are cut off at once, where a letter or digit stands before them.
_APART = (".", ",")
_LINE = f" {_MARK}\n {_MARK}"

#: How byte-level tokenizers spell bytes: visible characters stand for themselves, the rest follow from 256 on.
_VISIBLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_SPELLING = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _VISIBLE)}

#: The normalizers and pre-tokenizers whose cuts the chunks follow, as tokenizer files have them.  Texts of other
#: tokenizers are encoded whole.
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True}
_KNOWN = (
    (None, _BYTE_LEVEL | {"use_regex": True}, None),
    (
        {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
        {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": _WORDS}, "behavior": "Removed", "invert": True}, _BYTE_LEVEL | {"use_regex": False}]},
        "</w>",
    ),
)

_loaded: dict[str, "Encoder"] = {}


def vocabulary_path(name: str) -> str:
    """Place of a public tokenizer file; an absolute path stands for itself."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(name: str, entries: int = CACHE_ENTRIES) -> "Encoder":
    """The worker's encoder for a tokenizer file; kept between tasks, and the only one that is."""
    if name not in _loaded or _loaded[name].entries != entries:
        _loaded.clear()
        _loaded[name] = Encoder(vocabulary_path(name), entries)
    return _loaded[name]


class Encoder:
    """Ids of texts; ``spaced`` tokenizers keep a leading space in the token, others drop white space."""

    def __init__(self, path: str, entries: int = CACHE_ENTRIES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        told = json.loads(self.tokenizer.to_str())
        model = told["model"]
        plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
        special = all(t["special"] and not t["normalized"] and not t["single_word"] and not t["lstrip"] and not t["rstrip"] and t["content"].startswith("<|") for t in told["added_tokens"])
        #: Whether texts can be cut into chunks as below.
        self.known = plain and special and (told["normalizer"], told["pre_tokenizer"], model.get("end_of_word_suffix")) in _KNOWN
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.spaced = self.tokenizer.normalizer is None
        self.entries = entries
        names = self.tokenizer.get_vocab(with_added_tokens=True)
        self._space, self._line, self._ends = (np.zeros(max(names.values()) + 1, bool) for _ in range(3))
        for name, k in names.items():
            self._space[k], self._line[k], self._ends[k] = name[0] == "\u0120", name == "\u010a", name.endswith("</w>")
        self._clear()

    def _clear(self) -> None:
        # chunk 0 marks texts that can't be cut
        self.ids, self.starts = array("I"), array("q", [0, 0])
        self.chunks: dict[str, int] = {}
        self._flat: tuple[np.ndarray, np.ndarray] | None = None

    def _keep(self, ids) -> int:
        self.ids.extend(ids)
        self.starts.append(len(self.ids))
        self._flat = None
        return len(self.starts) - 2

    def _learn(self, pieces: list[str]) -> None:
        """Encodes new pieces, in few calls.  A piece of letters and one punctuation mark is put
        together from both, since the tokenizer always cuts there."""
        kept = self.chunks
        words: dict[str, None] = {}
        others: dict[str, None] = {}
        parts: list[tuple[str, str, str]] = []
        for p in pieces:
            core = p[1:] if self.spaced and p[:1] == _MARK else p
            if core.isalpha():
                words[p] = None
            elif self.spaced and core != "\n" and (not core or core[0].isspace() or core[-1].isspace() or _MARK in core):
                kept[p] = 0
            elif core[-1:] in _ENDS and core[:-1].isalpha() and (self.spaced or core[:-1].lower().isalpha()):
                mark = _MARK + core[-1] if self.spaced else core[-1]
                parts.append((p, p[:-1], mark))
                if p[:-1] not in kept:
                    words[p[:-1]] = None
                if mark not in kept:
                    others[mark] = None
            else:
                others[p] = None
        if self.spaced:
            self._words([p for p in words if p[0] != _MARK], " ", "", self._space)
            self._words([p for p in words if p[0] == _MARK], "", "\n", self._line)
        else:
            self._words(list(words), "", " ", self._ends)
        names = list(others)
        for p, e in zip(names, self.tokenizer.encode_batch_fast([self._text(p) for p in names], add_special_tokens=False)):
            kept[p] = self._keep(e.ids)
        for p, head, mark in parts:
            kept[p] = self._keep(self._of(kept[head]) + self._of(kept[mark]))

    def _text(self, p: str) -> str:
        return p if not self.spaced else p[1:] if p[:1] == _MARK else " " + p

    def _words(self, names: list[str], before: str, after: str, edge: np.ndarray) -> None:
        """Encodes words.  Latin ones go to the library's model at once: its normalizer and pre-tokenizer would do no
        more than lower their case and spell their bytes.  Others are encoded as one text, in which ``edge``
        marks the ids at which one ends or the next begins."""
        tokenize, lead = self.tokenizer.model.tokenize, before.translate(_SPELLING)
        others, known, flat, sizes = [], [], [], []
        for p in names:
            word = p[1:] if p[0] == _MARK else p
            if word.isascii():
                spelt = word if self.spaced else word.lower()
            elif max(word) < "\u0250" and "\u0130" not in word:
                spelt = (word if self.spaced else "".join(map(str.lower, word))).encode().decode("latin-1").translate(_SPELLING)
            else:
                others.append(p)
                continue
            got = tokenize(lead + spelt)
            known.append(p)
            sizes.append(len(got))
            flat += [x.id for x in got]
        self._append(known, np.array(flat, np.uint32), np.cumsum(sizes))
        for at in range(0, len(others), 20_000):
            part = others[at : at + 20_000]
            text = "".join([before + p.lstrip(_MARK) + after for p in part])
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            cuts = np.flatnonzero(edge[ids])
            if len(cuts) != len(part):  # e.g. letters that lower-casing turns into several characters
                for p, e in zip(part, self.tokenizer.encode_batch_fast([self._text(p) for p in part], add_special_tokens=False)):
                    self.chunks[p] = self._keep(e.ids)
                continue
            if edge is self._line:
                ids, ends = np.delete(ids, cuts), cuts - np.arange(len(cuts))
            elif edge is self._space:
                ends = np.append(cuts[1:], len(ids))
            else:
                ends = cuts + 1
            self._append(part, ids, ends)

    def _append(self, names: list[str], ids: np.ndarray, ends: np.ndarray) -> None:
        n, base = len(self.starts) - 1, len(self.ids)
        self.ids.frombytes(ids.tobytes())
        self.starts.frombytes((ends + base).astype(np.int64).tobytes())
        self.chunks.update(zip(names, range(n, n + len(names))))
        self._flat = None

    def _of(self, chunk: int) -> array:
        return self.ids[self.starts[chunk] : self.starts[chunk + 1]]

    def _cut(self, texts: list[str | None]) -> tuple[np.ndarray, list[str], np.ndarray]:
        """Pieces as numbers into the distinct ones, those, and the number of each text's pieces."""
        mark = _MARK if self.spaced else ""
        whole = pa.array([mark + (t or "") for t in texts], pa.large_string())
        whole = pc.replace_substring(whole if self.spaced else pc.ascii_lower(whole), "\n", _LINE if self.spaced else " ")
        for end in _APART:
            whole = pc.replace_substring(whole, end + " ", f" {mark}{end} ")
        pieces = pc.split_pattern(whole, " ")
        flat = pieces.flatten().dictionary_encode()
        return flat.indices.to_numpy(), flat.dictionary.to_pylist(), pc.list_value_length(pieces).to_numpy().astype(np.int64)

    def _joined(self, kind: np.ndarray, names: list[str]) -> np.ndarray:
        """Places of punctuation marks cut off from what isn't a letter or digit; the tokenizer may not cut there."""
        marks = {(_MARK if self.spaced else "") + x for x in _APART}
        mark = np.array([k for k, n in enumerate(names) if n in marks], np.int64)
        at = np.flatnonzero(np.isin(kind, mark))
        ahead, place = np.unique(kind[at - 1], return_inverse=True)
        word = np.array([(n if self.spaced else n.lower())[-1:].isalnum() for n in map(names.__getitem__, ahead.tolist())], bool)
        return at[(at == 0) | ~word[place]]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other (uint32), and the number of each text's ids."""
        if not self.known:
            found = [e.ids for e in self.tokenizer.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]
            return np.array([i for ids in found for i in ids], np.uint32), np.array([len(ids) for ids in found], np.int64)
        if len(self.starts) > self.entries:
            self._clear()
        kind, names, sizes = self._cut(texts)
        found = list(map(self.chunks.get, names))
        if None in found:
            self._learn([p for p, k in zip(names, found) if k is None])
            found = list(map(self.chunks.__getitem__, names))
        chunk = np.array(found, np.int64)[kind]
        chunk[self._joined(kind, names)] = 0
        if self._flat is None:
            self._flat = (np.frombuffer(self.ids, np.uint32) if len(self.ids) else np.empty(0, np.uint32)).copy(), np.frombuffer(self.starts, np.int64).copy()
        all_ids, starts = self._flat
        n = (starts[1:] - starts[:-1])[chunk]
        ends = np.cumsum(n)
        last = np.concatenate([[0], np.cumsum(sizes)])
        before = np.concatenate([[0], ends])[last]
        counts = before[1:] - before[:-1]
        place = np.repeat((starts[chunk] - ends + n).astype(np.int32), n)
        place += np.arange(len(place), dtype=np.int32)
        ids = all_ids[place]
        del place
        whole = np.unique(np.searchsorted(last, np.flatnonzero(chunk == 0), side="right") - 1)
        # the mark itself in a text; special tokens, which are told by case
        odd = _MARK if self.spaced else "<|"
        whole = np.union1d(whole, [k for k, t in enumerate(texts) if t and odd in t]).astype(np.int64)
        if len(whole):
            at = np.concatenate([[0], np.cumsum(counts)])
            own = dict(zip(whole.tolist(), self.tokenizer.encode_batch_fast([texts[k] or "" for k in whole], add_special_tokens=False)))
            ids = np.concatenate([np.asarray(own[k].ids, np.uint32) if k in own else ids[at[k] : at[k + 1]] for k in range(len(texts))])
            for k, e in own.items():
                counts[k] = len(e.ids)
        return ids, counts

    def encode_in_blocks(self, texts: list[str | None], characters: int = 4_000_000):
        """(first, last, ids, counts) for blocks of texts of a bounded size (one very long text may exceed it)."""
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end] or "") <= characters):
                size += len(texts[end] or "")
                end += 1
            yield at, end, *self.encode(texts[at:end])
            at = end


def gathered(batches: Iterator[pa.RecordBatch], characters: int = 4_000_000) -> Iterator[tuple[list, list[str | None]]]:
    """doc_id and text of record batches, put together up to a size: chunks that texts share are then looked up once."""
    docs: list = []
    texts: list[str | None] = []
    size = 0
    for b in batches:
        more = b.column("text").to_pylist()
        docs += b.column("doc_id").to_pylist()
        texts += more
        size += sum(len(t) for t in more if t)
        if size >= characters:
            yield docs, texts
            docs, texts, size = [], [], 0
    if docs:
        yield docs, texts


def crc32(ids: np.ndarray) -> int:
    """Unsigned CRC-32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())
