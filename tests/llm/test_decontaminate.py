from __future__ import annotations

import random

from pyspark.sql import functions as F

from lexloom.llm import decontaminate
from lexloom.llm.store import table
from tests.llm.conftest import edge_rows

ITEM = ("A train leaves Springfield at 9 and goes 60 km to Shelbyville. Then the train from Springfield "
        "waits 15 minutes before it drives on to Ogdenville with 9 people in each car.")


def prose(rng, n):
    return " ".join(f"w{rng.choice('abcdefgh')}{rng.choice('klmnop')}x{rng.randrange(40)}q".replace("0", "o")
                    for _ in range(n))


def items(spark, rows):
    return spark.createDataFrame([(i, t, 1, "k") for i, t in rows],
                                 "item_id long, text string, windows int, kind string")


def found(df):
    return {(r.doc_id, r.item_id): r.kind for r in df.collect()}


def test_changed_questions(spark, docs, work):
    rng = random.Random(4)
    changed = (ITEM.replace("Springfield", "Berlin").replace("Shelbyville", "Potsdam").replace("9", "7")
               .replace("60", "1,200.5").replace("15", "45").replace("km", "miles").replace("Ogdenville", "Mainz"))
    mixed = changed.replace("from Berlin", "from Hamburg")
    rows = [(1, prose(rng, 50) + " and " + ITEM + " " + prose(rng, 40)), (2, prose(rng, 30) + ". " + changed),
            (3, prose(rng, 30) + ". " + mixed), (4, prose(rng, 200)), (5, ITEM[:60] + " " + prose(rng, 90)),
            (6, "1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16"), (7, mixed + "\n" + ITEM), (8, ITEM), (8, ITEM)]
    bench = items(spark, [(10, ITEM), (11, "3 4 5 6 7 8 9 10 11"), (12, "w x y z"), (13, None), (14, ""), (15, "two words")])
    result = decontaminate.contaminated(docs(rows), bench, work)
    # Item 11 is made of numbers only; document 6 holds it word for word.
    assert found(result) == {(1, 10): "verbatim", (2, 10): "changed", (6, 11): "verbatim", (7, 10): "verbatim",
                             (8, 10): "verbatim"}
    assert result.count() == 6
    kept = decontaminate.drop_contaminated(docs(rows), bench, work)
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 5]
    assert kept.columns == docs(rows).columns


def test_changed_twice(spark, docs, work):
    """Two copies with other fillings, and a stray window of another filling, hide no copy."""
    rng = random.Random(5)
    one = ITEM.replace("Springfield", "Berlin").replace("60", "70").replace("9", "7")
    two = ITEM.replace("Springfield", "Hamburg").replace("60", "80").replace("9", "8")
    stray = "a train leaves Paris at 4 and goes 5 km to Lyon"
    longer = [t.replace("waits", "really waits") for t in (one, two)]
    rows = [(1, f"{one} {prose(rng, 40)}. {two}"), (2, f"{one} {prose(rng, 40)} {stray} {prose(rng, 40)}"),
            (3, f"{longer[0]} {prose(rng, 40)}. {longer[1]}"), (4, f"{prose(rng, 40)} {stray}")]
    got = found(decontaminate.contaminated(docs(rows), items(spark, [(10, ITEM)]), work))
    assert got == {(1, 10): "changed", (2, 10): "changed", (3, 10): "changed"}


def test_short_items(spark, docs, work):
    rows = [(1, "we ask what is the capital of France today"), (2, "what is the")]
    bench = items(spark, [(1, "What is the capital of France?"), (2, "of France")])
    assert set(found(decontaminate.contaminated(docs(rows), bench, work))) == {(1, 1)}


def test_poor_items(spark, docs, work):
    """Items with few plain words, in capitals or with names at sentence starts."""
    bench = items(spark, [
        (1, "Compute 12 + 7 - 3 + 9 * 4 - 2"), (2, "WHAT IS THE NAME OF THE LONGEST RIVER IN EUROPE AND ASIA"),
        (3, "Tom has 5 apples. Tom buys 3 more. How many apples does Tom have?"),
        (4, "What is the capital of France today"), (5, "the train goes on to Berlin and waits there for 5 km more people to come"),
        (6, "Wie viele Kinder spielen am Montag im Garten von Frau Weber?")])
    rows = [(1, "Now Compute 12 + 7 - 3 + 9 * 4 - 2 by hand"), (2, "Compute 12 + 7 - 3 + 9 * 4 - 1"),
            (3, "he asks WHAT IS THE NAME OF THE LONGEST RIVER IN EUROPE AND ASIA then"),
            (4, "what is the name of the longest river in Europe and Asia"),
            (5, "Ann has 8 apples. Ann buys 2 more. How many apples does Ann have?"),
            (6, "Ann has 8 apples. Eve buys 2 more. How many apples does Ann have?"),
            (7, "we ask What is the capital of France today or so"), (8, "we ask what is the capital of Spain today"),
            (9, "what is the capital of france today"),
            (10, "so the train goes on to New York City and waits there for 9 miles more people to come"),
            (11, "Frage: Wie viele Kinder spielen am Montag im Garten von Frau Weber?")]
    got = found(decontaminate.contaminated(docs(rows), bench, work))
    assert got == {(1, 1): "verbatim", (3, 2): "verbatim", (4, 2): "verbatim", (5, 3): "changed",
                   (7, 4): "verbatim", (8, 4): "changed", (9, 4): "verbatim", (10, 5): "changed", (11, 6): "verbatim"}


def test_short_sentences_and_own_units(spark, docs, work):
    bench = items(spark, [(1, "Why not?"), (2, "the ship sails 5 knots against the wind and the tide")])
    rows = [(1, "He left. Why not?"), (2, "and why not now"), (3, "WHY NOT"),
            (4, "the ship sails 7 furlongs against the wind and the tide")]
    assert found(decontaminate.contaminated(docs(rows), bench, work)).keys() == {(1, 1), (3, 1)}
    got = found(decontaminate.contaminated(docs(rows), bench, work, units=("knots", "Furlongs")))
    assert got == {(1, 1): "verbatim", (3, 1): "verbatim", (4, 2): "changed"}


def test_against_patterns(spark, docs, work):
    """Consistent refillings, and no others, as a pattern with back references finds them."""
    import re

    rng = random.Random(9)
    names = ["Ann", "Bob Stone", "New York", "Rio", "Élise", "Max"]
    shapes = ["yesterday {a} gave {n} small red boxes to {b} while {a} kept {m} of them at home for {b}",
              "in the town of {b} lives {a} who walks {n} km each day and meets {b} after {m} km of road",
              "the old farm near {a} sold {n} goats and {n} sheep but {b} near {a} sold only {m} goats then"]

    def fill(shape, broken):
        a, b = rng.sample(names, 2)
        n, m = rng.sample(range(10, 99), 2)
        out = shape.format(a="\1", b=b, n=n, m=m)
        return out.replace("\1", a, 1).replace("\1", "Kim" if broken else a)

    bench = [(i, fill(s, False)) for i, s in enumerate(shapes)]
    rows = [(d, f"{prose(rng, rng.randrange(30))} and {fill(rng.choice(shapes), d % 3 == 0)} {prose(rng, 20)}")
            for d in range(60)]
    slot = {"a": r"[^\W\d_]+(?: [A-ZÉ][^\W\d_]+)*", "b": r"[^\W\d_]+(?: [A-ZÉ][^\W\d_]+)*", "n": r"\d+", "m": r"\d+"}

    def pattern(shape):
        seen = set()

        def one(m):
            k = m.group(1)
            if k in seen:
                return f"(?P={k})"
            seen.add(k)
            return f"(?P<{k}>{slot[k]})"

        return re.compile(re.sub(r"\{(\w)\}", one, shape))

    expected = {(d, i): "verbatim" if q in t else "changed"
                for d, t in rows for i, q in bench if pattern(shapes[i]).search(t)}
    assert 35 <= len(expected) <= 45
    assert found(decontaminate.contaminated(docs(rows), items(spark, bench), work)) == expected


def test_edges(spark, docs, work):
    edges = edge_rows()
    assert found(decontaminate.contaminated(docs(edges), items(spark, [(1, ITEM)]), work)) == {}
    assert found(decontaminate.contaminated(docs(edges), items(spark, []), work)) == {}
    assert found(decontaminate.contaminated(docs([]), items(spark, [(1, ITEM)]), work)) == {}
    assert decontaminate.drop_contaminated(docs(edges), items(spark, []), work).count() == len(edges)
    assert found(decontaminate.contaminated(docs([(None, ITEM)]), items(spark, [(None, ITEM), (2, ITEM)]), work)).keys() >= {(None, 2)}


def test_large_sets_are_shuffled(spark, docs, work, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    assert found(decontaminate.contaminated(docs([(1, ITEM), (2, "no")]), items(spark, [(1, ITEM)]), work)) == {
        (1, 1): "verbatim"}


def test_registered(spark, sf_dir):
    """Items that stand word for word in a document are found; nothing else shares half of one."""
    import re

    low = lambda t: " ".join(re.findall(r"[^\W_]+", t.lower()))
    docs = {r.doc_id: low(r.text) for r in table(spark, sf_dir, "documents").collect()}
    bench = {r.item_id: low(r.text) for r in table(spark, sf_dir, "benchmark").collect()}
    expected = {(d, i) for d, t in docs.items() for i, q in bench.items() if f" {q} " in f" {t} "}
    got = found(decontaminate.op6_decontaminate(spark, sf_dir))
    assert set(got) == expected and set(got.values()) == {"verbatim"}


def test_few_texts_are_read_in_full(spark, docs, work, monkeypatch):
    """Texts without an item's rarest neighbouring words get no readings; an item without neighbours is found all the same."""
    rng = random.Random(11)
    read = []
    windows = decontaminate._document_windows
    monkeypatch.setattr(decontaminate, "_document_windows",
                        lambda rows, *rest: (read.append(rows.select("node").count()), windows(rows, *rest))[1])
    rows = [(d, prose(rng, 80)) for d in range(40)] + [(50, f"{prose(rng, 9)} {ITEM}"), (51, f"{prose(rng, 9)} {ITEM}"), (51, ITEM)]
    assert found(decontaminate.contaminated(docs(rows), items(spark, [(1, ITEM)]), work)) == {
        (50, 1): "verbatim", (51, 1): "verbatim"}
    assert read == [3]
    alone = items(spark, [(1, "take 3 apples 4 pears 5 plums 6"), (2, "Now!"), (3, "why not")])
    rows += [(60, "and take 5 apples 7 pears 8 plums 9"), (61, "take 5 apples or pears"), (62, "Wait. Now."), (63, "Why not? Wait"), (64, "not now why")]
    assert found(decontaminate.contaminated(docs(rows), alone, work)) == {
        (60, 1): "changed", (62, 2): "verbatim", (63, 3): "verbatim"}
    assert len(read) == 2 and read[1] < 10
