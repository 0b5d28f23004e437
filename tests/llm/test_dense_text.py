"""Personal data in texts without spaces."""

from lakespark.llm import pii


def test_entities_in_long_runs():
    model = pii.fit(pii.sentences())
    phones = [f"{200 + 37 * k}-{300 + 41 * k}-{4000 + 53 * k}" for k in range(12)]
    for text in (",".join(phones), '{"rows":["' + '","'.join(phones) + '"]}', "https://x.org/find?q=" + "&r=".join(phones), "id,tel\n1," + phones[0] + ",x\n2," + phones[1] + ",y"):
        _, every = pii.find(text, model)
        got = [text[a:z] for a, k, z in every if pii.KINDS[k] == "phone"]
        want = [p for p in phones if p in text]
        assert set(got) <= set(want) and len(got) >= 0.9 * len(want), (text, every)
