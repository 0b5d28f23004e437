"""Edited, re-parameterised and short benchmark items."""

from test_native import ITEM, leaks

FILLER = "Some other words stand here before the question begins. "


def test_an_edited_value_hides_no_verbatim_run(spark):
    number = "the farmer bought 12 sacks of seed and put them in the old barn near the river while the other 12 stayed on the cart until the evening came"
    texts = [FILLER + ITEM.replace("Alice has", "Carol has", 1), FILLER + number.replace("12 stayed", "15 stayed"), FILLER * 3, ITEM.replace("Alice", "Carol", 1).replace("Bob", "Dan").replace("apples,", "pears,").replace("14", "9").replace("please", "kindly")]
    got = leaks(spark, texts, [ITEM, number])
    assert set(got) == {(0, 0), (1, 1)} and not any(r.reparameterised for r in got.values())


def test_values_are_consistent_in_a_stretch(spark):
    item = "Alice put seven blue stones into the wooden box and then Alice closed the heavy box with a small key before Alice went home to sleep until morning"
    text = item.replace("Alice", "Carol", 2).replace("Alice", "Erin").replace("small key", "large lock")
    got = leaks(spark, [FILLER + text, item.replace("Alice", "Carol", 1).replace("Alice", "Erin", 1).replace("put", "set").replace("heavy", "light").replace("morning", "evening").replace("key", "lock")], [item])
    assert set(got) == {(0, 0)} and got[0, 0].reparameterised


def test_values_of_other_lengths(spark):
    item = "the shop sold 500 red lamps in Paris last year and each of them cost 3 dollars so how much money did the shop in Paris earn from 500 lamps"
    swapped = [
        item.replace("500", "1,250").replace("Paris", "New York"),
        item.replace("500", "2.5").replace("3 dollars", "1/2 dollars"),
        item.replace("3 dollars", "1 1/2 dollars").replace("500", "12,000,000"),
        item.replace("Paris", "Rio De Janeiro"),
        item.replace("PARIS", "x").lower(),
    ]
    long = item.replace("500", "1,250").replace("Paris", "New York")
    got = leaks(spark, [FILLER + t for t in swapped] + [FILLER * 3], [item, long])
    assert {(k, i) for k in range(5) for i in (0, 1)} <= set(got) and not any(d == 5 for d, _ in got)
    assert not got[0, 1].reparameterised and not got[4, 0].reparameterised


def test_few_words_and_short_items_match_verbatim(spark):
    sums, short, numbers = "Compute 12 * 7 + 30 / 5 - 2 * 9 + 4", "What is 12 + 30?", "3 1 4 1 5 9 2 6 5 3 5 8 9 7 9 3 2 3 8 4"
    texts = [FILLER + sums + " now.", FILLER + short, FILLER + numbers, FILLER + sums.replace("12", "13"), FILLER + "What is 12 + 31?", FILLER + numbers.replace("9", "8"), "so what is 12 + 30 then", "Compute 12 * 7"]
    got = leaks(spark, texts, [sums, short, numbers])
    assert set(got) == {(0, 0), (1, 1), (2, 2), (6, 1)} and not any(r.reparameterised for r in got.values())
