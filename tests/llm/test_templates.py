"""Template decontamination against a plain version, and on generated questions with other names, numbers and units."""

from __future__ import annotations

import random

import regex

from riskloom.llm import op6_templates
from tests.llm.conftest import frame

UNITS = set(op6_templates.UNITS.split("|"))


def tokens(text):
    """(kind, value) of each token: n(ame), # number, u(nit), w(ord); one scan from left to right."""
    out = []
    pattern = r"(?P<n>(?<!\p{L})\p{Lu}[\p{L}'-]*(?: \p{Lu}[\p{L}'-]*)*)|(?P<num>[0-9][0-9.,:/]*[0-9]|[0-9])(?: *(?P<unit>[a-z]+)(?!\p{L}))?|(?P<w>\p{L}+)"
    at = 0
    while m := regex.compile(pattern).search(text or "", at):
        at = m.end()
        if m["n"]:
            out.append(("n", m["n"].lower().split(" ")[-1]))
        elif m["num"]:
            out.append(("#", m["num"]))
            if m["unit"] in UNITS:
                out.append(("u", m["unit"]))
            else:
                at = m.end("num")
        else:
            out.append(("w", m["w"].lower()))
    return out


def kinds(window):
    return tuple(v if k == "w" else k for k, v in window)


def plain(window):
    return sum(k == "w" for k, _ in window)


def leaks(text, item):
    """None, verbatim or reparameterised."""
    d, i = tokens(text), tokens(item)
    if len(i) < 5:
        return "verbatim" if d == i and plain(i) else None
    cut = lambda t: [(k, t[k : k + 5]) for k in range(len(t) - 4)]
    own = [(k, w) for k, w in cut(i) if plain(w) >= 2]
    n = len({kinds(w) for _, w in own})
    met = [(a - b, x, y) for a, x in cut(d) for b, y in own if kinds(x) == kinds(y)]
    sound, same = set(), set()
    for o, x, y in met:
        pairs = {(p, q) for o2, x2, y2 in met if o2 == o for p, q in zip(y2, x2) if p[0] != "w"}
        if x == y:
            same.add(kinds(x))
        if x == y or len(pairs) == len({p for p, _ in pairs}) == len({q for _, q in pairs}):
            sound.add(kinds(x))
    if not n or not (2 * len(same) >= n or 2 * len(sound) >= n and len(sound) >= 4):
        return None
    return "verbatim" if sound == same else "reparameterised"


NAMES = ["Tom", "Anna", "Joe", "Mary Smith", "Lee", "Olga", "Piet", "Rosa Maria Diaz", "Sam", "Uma"]
THINGS = ["apples", "books", "stones", "tickets", "pears", "coins", "lamps", "ropes"]


def question(r):
    """(pattern, number of names, of numbers): sentences about a few people, numbers and units."""
    verb = lambda: r.choice(["has", "buys", "sells", "finds", "carries", "loses", "paints", "wants"])
    s = [f"{{a{k % 2}}} {verb()} {{n{k}}} {r.choice(THINGS)} and {{n{k + 3}}} {{u}} of {r.choice(THINGS)}" for k in range(3)]
    return r.choice([". ", ".\n", "; "]).join(s) + f". How many {r.choice(THINGS)} are left for {{a{r.randrange(2)}}}?"


def filled(pattern, r):
    names = r.sample(NAMES, 2)
    numbers = r.sample(range(2, 900), 6)
    return pattern.format(u=r.choice(["kg", "km", "miles", "hours"]), **{f"a{k}": x for k, x in enumerate(names)}, **{f"n{k}": x for k, x in enumerate(numbers)})


def test_generated_questions(spark):
    r = random.Random(11)
    patterns = [question(r) for _ in range(60)]
    items = [(k, filled(p, r)) for k, p in enumerate(patterns)]
    words = lambda n: " ".join(r.choice(["ka", "lomi", "terun", "os", "mika", "unlo", "Kater"]) for _ in range(n))
    docs, planted, spoiled = [], {}, {}
    for k, p in enumerate(patterns):
        for text in (filled(p, r), items[k][1]):
            planted[len(docs)] = k
            docs.append((len(docs), f"{words(20)}. {text} {words(20)}", "s"))
        # the person of the first sentence is another one in the third: not the same question
        spoiled[len(docs)] = k
        docs.append((len(docs), filled(p.replace("{a0}", "Quin", 1).replace("{a0}", "Vera"), r), "s"))
    docs += [(1000 + k, words(80), "s") for k in range(40)]
    got = {(x.doc_id, x.item_id): x.kind for x in op6_templates.leaks(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {(d, i): kind for d, t, _ in docs for i, q in items if (kind := leaks(t, q))}
    assert got == want
    assert sum((d, k) in got for d, k in planted.items()) >= 0.9 * len(planted)
    assert not any(d >= 1000 or spoiled.get(d) == i for d, i in got)
    assert sum(got[d, k] == "reparameterised" for d, k in planted.items() if (d, k) in got) >= 50


def test_names_at_the_start_of_texts_lines_and_sentences(spark):
    items = spark.createDataFrame([(9, "Tom has 3 apples. Tom eats 2 apples. How many are left?")], "item_id long, text string")
    docs = [(1, "Tom has 3 apples. Tom eats 2 apples. How many are left?", "s"), (2, "Anna has 7 apples. Anna eats 5 apples. How many are left?", "s"), (3, "Anna has 7 apples. Joe eats 5 apples. How many are left?", "s"), (4, "Look\nOlga Berg has 12 apples. Olga Berg eats 10 apples. How many are left?", "s")]
    assert {(x.doc_id, x.kind) for x in op6_templates.leaks(frame(spark, docs), items).collect()} == {(1, "verbatim"), (2, "reparameterised"), (4, "reparameterised")}


def test_short_items_and_placeholders_leave_texts_alone(spark):
    items = spark.createDataFrame([(1, "42"), (2, "Tom"), (3, "what is it"), (4, "3 4 Tom 5 Anna 6"), (5, "one"), (6, None), (7, "")], "item_id long, text string")
    docs = [(1, "It was 17 of them", "s"), (2, "42", "s"), (3, "and so what is it that Tom says", "s"), (4, "3 4 Tom 5 Anna 6", "s"), (5, "what is it?", "s"), (6, "One", "s"), (7, "one", "s"), (8, None, "s")]
    assert {(x.doc_id, x.item_id) for x in op6_templates.leaks(frame(spark, docs), items).collect()} == {(5, 3), (7, 5)}
    assert {x.item_id for x in op6_templates.unmatchable(items).collect()} == {1, 2, 4, 6, 7}
    assert {x.doc_id for x in op6_templates.clean(frame(spark, docs), items).collect()} == {1, 2, 3, 4, 6, 8}


def test_query_on_odd_rows(spark, odd, none, tmp_path):
    odd.write.parquet(str(tmp_path / "documents.parquet"))
    items = [(1, "same text here with five words"), (2, None), (3, ""), (4, "one"), (1, "same text here with five words")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = sorted(tuple(x) for x in op6_templates.op6_templates(spark, str(tmp_path)).select("doc_id", "item_id", "kind").collect())
    assert got == [(4, 4, "verbatim"), (7, 1, "verbatim"), (8, 1, "verbatim")]
    assert op6_templates.leaks(none, spark.read.parquet(str(tmp_path / "benchmark.parquet"))).count() == 0
