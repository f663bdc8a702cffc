"""Operators that learn: held-out accuracy and odd inputs; decontamination; the pipeline."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

from fernglass.llm import decontamination, langid, toxicity

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def sample(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")


def test_language_held_out(sample):
    docs, _ = sample
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_odd_inputs(make):
    rows = [(i, f"the house and the garden {i} of the king" if i % 2 else f"das haus und der garten {i} des königs", "en" if i % 2 else "de") for i in range(60)]
    rows += [(100, None, "en"), (101, "", None), (102, "12 + 34!", "de"), (103, "das alte haus und der hof", None), (None, "the old house", "en"), (104, "é" * 50_000, None), (103, "das alte haus und der hof", None)]
    every = langid.identify(make(rows)).collect()
    got = {r["doc_id"]: r for r in every}
    assert len(every) == len(rows) and len({r["score"] for r in every if r["doc_id"] == 103}) == 1
    assert all((got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0) for i in (100, 101, 102))
    assert got[103]["lang_pred"] == "de" and got[None]["lang_pred"] == "en" and got[104]["lang_pred"] in ("en", "de")
    assert langid.identify(make([])).count() == 0
    assert [r["lang_pred"] for r in langid.identify(make([(1, "abc", None)])).collect()] == ["und"]


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.learn(docs, labels)
    got = toxicity.predict(docs, model).where("held_out").join(labels, "doc_id").collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in got)
    pos, neg = [r["score"] for r in got if r["toxic"] == 1], [r["score"] for r in got if r["toxic"] == 0]
    rank = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert rank > 0.8 and sum(n >= 0.5 for n in neg) / len(neg) < 0.02 and sum(p >= 0.5 for p in pos) / len(pos) > 0.35


def test_toxicity_windows_are_the_whole_text():
    for text in (b"", b"one", "ein l\u00e4ngerer Text, mit Zeichen! und WORTEN ".encode() * 9, b"x" * 500, "\u6f22\u5b57".encode() * 90):
        f = toxicity.folded(text)
        assert b"".join(w[:-1] for w in toxicity.windows(f, 48)) in (f, f[:-1], b"") and sum(map(len, toxicity.windows(f, 48))) >= len(f)


def test_toxicity_odd_inputs(make, spark):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(200)]
    rows, labels = [], []
    for i in range(200):
        w = [rng.choice(words) for _ in range(60)]
        if i % 5 == 1:
            w[10] = w[40] = "grumblesnatch"
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(i % 5 == 1)))
    rows += [(900, None), (901, ""), (902, "Grumblesnatch! grumblesnatch grumblesnatch"), (None, "x"), (903, " ".join(words) * 200), (900, None)]
    docs = make(rows)
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.learn(docs, table)
    got = toxicity.predict(docs, model).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows) and by[902]["predicted"] == 1 and by[900]["predicted"] == by[901]["predicted"] == by[903]["predicted"] == 0
    wrong = [i for i, _, y in labels if by[i]["predicted"] != y]
    assert len(wrong) <= 4
    kept = toxicity.predict(docs, model, keep=True)
    assert kept.columns == docs.columns and kept.count() == sum(r["predicted"] == 0 for r in got)
    nothing = table.where("toxic = 7")
    assert toxicity.learn(docs, nothing) is None and toxicity.predict(docs, None).agg(F.max("score")).first()[0] == 0.0
    assert toxicity.predict(docs, None, keep=True).count() == len(rows) and toxicity.predict(make([]), model).count() == 0


ITEMS = [
    (1, "When Tom buys 12 apples for 3 dollars each then how much does Tom pay for 12 apples in total?"),
    (2, "Wo steht das schöne alte Haus am Ende der langen Gasse von Köln?"), (3, None), (4, "12 13 14"), (5, "one two three four five six"),
]


def test_decontamination(make, spark):
    b = spark.createDataFrame(ITEMS, "item_id long, text string")
    rows = [
        (1, "Intro. " + ITEMS[0][1] + " Outro."), (2, "When Ann buys 17 apples for 4 euros each then how much does Ann pay for 17 apples in total?"),
        (3, "When Ann buys 17 apples for 4 euros each then how much does Bob pay for 99 apples in total?"), (4, ITEMS[1][1].upper()), (5, "unrelated words " * 50), (6, None), (7, ""), (8, "12 13 14 15"),
        (None, "say one two three four five six now"), (9, "x " * 30_000 + ITEMS[1][1]), (1, "Intro. " + ITEMS[0][1]),
    ]
    docs = make(rows)
    got = decontamination.contaminated(docs, b)
    assert sorted(((r["doc_id"] or 0, r["item_id"]) for r in got.collect())) == [(0, 5), (1, 1), (1, 1), (2, 1), (4, 2), (9, 2)]
    changed = {r["doc_id"]: r["n_changed"] for r in got.collect() if r["doc_id"] is not None}
    assert changed[1] == 0 and changed[2] == 6
    kept = decontamination.clean(docs, b)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [3, 5, 6, 7, 8]
    assert decontamination.contaminated(docs, b.where("item_id > 9")).count() == 0 and decontamination.clean(make([]), b).count() == 0


def test_items_with_few_literals_are_found_word_for_word(make, spark):
    items = [
        (1, "What is 37 + 48 - 12 * 5?"), (2, "1914 1918 1939 1945 1789 1815 1848 1871 1066 1492"), (3, "List Anna Bert Carl Dora Emil Fritz Gustav Hanna Ida Jakob"),
        (4, "Add 3 kg 5 kg 7 kg 9 kg then say what the whole of it is in grams when two kg are lost"), (5, "7 8 9"),
    ]
    b = spark.createDataFrame(items, "item_id long, text string")
    rows = [(i, f"before it. {t} after it") for i, t in items] + [(10, "What is 38 + 48 - 12 * 5?"), (11, "1914 1918 1939 1946 1789 1815 1848 1871 1067 1492"), (12, items[2][1].upper()), (13, "List Otto Paul Carl Dora Emil Rosa Gustav Hanna Tom Jakob")]
    got = decontamination.contaminated(make(rows), b).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in got) == [(1, 1), (2, 2), (3, 3), (4, 4), (12, 3)]
    assert all(r["n_windows"] == r["item_windows"] and r["n_changed"] == 0 for r in got)
    assert sorted(r["doc_id"] for r in decontamination.clean(make(rows), b).collect()) == [5, 10, 11, 13]


def test_benchmark_filter_is_bounded(make, spark, monkeypatch):
    """A filter far too small for the benchmark costs time, not results; repeated items are each found."""
    b = spark.createDataFrame([*ITEMS, ITEMS[0]], "item_id long, text string")
    docs = make([(1, ITEMS[0][1]), (2, ITEMS[1][1] + " " + ITEMS[0][1]), (3, "nothing of that kind is here " * 20)])
    want = [(1, 1), (1, 1), (2, 1), (2, 1), (2, 2)]
    for bits in (1 << 28, 1 << 6):
        monkeypatch.setattr(decontamination, "FILTER_BITS", bits)
        assert sorted((r["doc_id"], r["item_id"]) for r in decontamination.contaminated(docs, b).collect()) == want


def brute_templates(text):
    """(kind, key, value) of every token, by a plain reading of the rules for ASCII texts."""
    import re

    out, opening, before = [], True, None
    for m in re.finditer(r"[0-9A-Za-z]+(?:[.,](?<=[0-9][.,])(?=[0-9])[0-9A-Za-z]+)*|[\n!.:;?]", text):
        w = m.group()
        if re.fullmatch(r"[\n!.:;?]", w):
            opening = True
            continue
        if w[0].isdigit():
            kind = "number"
        elif before == "number" and w.lower() in decontamination.UNITS:
            kind = "unit"
        elif w[0].isupper() and not opening and not w[1:2].isupper():
            kind = "name"
        else:
            kind = None
        out.append((kind, w.lower()))
        before, opening = kind, False
    return out


def test_reparameterised_items_by_brute_force(make, spark):
    """Items with new numbers, names and units are found exactly where aligned templates with one renaming say so."""
    rng = random.Random(8)
    plain = "the of how many does each then when if there are in total after giving some away more than left now".split()
    names, units = "Ada Bob Cy Dee Eve Flo Gus Hal".split(), "kg miles hours dollars litres".split()

    def say(slots):
        return " ".join(f"{w}" if not isinstance(w, tuple) else slots[w] for w in words)

    items, docs = [], []
    for i in range(12):
        words = [rng.choice(plain) for _ in range(26)]
        for at in rng.sample(range(1, 25), 7):
            words[at] = rng.choice([("name", rng.randint(0, 1)), ("number", rng.randint(0, 2))])
        fill = lambda: {**dict(zip([("name", k) for k in range(2)], rng.sample(names, 2))), **dict(zip([("number", k) for k in range(3)], map(str, rng.sample(range(2, 99), 3))))}
        items.append((i, say(fill()) + f" in {rng.randint(100, 200)} {rng.choice(units)} of it all as told"))
        docs.append((100 + i, "Before that. " + say(fill()) + " after that"))
        mixed = [w if not isinstance(w, tuple) else fill()[w] for w in words]
        docs.append((200 + i, "Before that. " + " ".join(mixed) + " after that"))
    docs += [(300, " ".join(plain * 9)), (301, items[0][1] + ". " + items[1][1])]
    b = spark.createDataFrame(items, "item_id long, text string")

    def holds(doc, item):
        d, t = brute_templates(doc), brute_templates(item)
        k = min(8, len(t))
        found, same = set(), set()
        for offset in range(-len(t), len(d)):
            qs = [q for q in range(len(t) - k + 1) if 0 <= q + offset <= len(d) - k]
            alike = {q for q in qs if all((x[0] or x[1]) == (y[0] or y[1]) for x, y in zip(t[q : q + k], d[q + offset : q + offset + k])) and sum(x[0] is None for x in t[q : q + k]) >= 4}
            equal = {q for q in qs if [x[1] for x in t[q : q + k]] == [y[1] for y in d[q + offset : q + offset + k]]}
            slots = sorted({j for q in alike for j in range(q, q + k) if t[j][0]})
            there, back, good = {}, {}, 0
            for j in slots:
                a, c = (t[j][0], t[j][1]), (t[j][0], d[j + offset][1])
                good += there.setdefault(a, c) == c and back.setdefault(c, a) == a
            if good >= 0.9 * len(slots):
                found |= alike
            same |= equal
        usable = sum(sum(x[0] is None for x in t[q : q + k]) >= 4 for q in range(len(t) - k + 1))
        return bool(found) and len(found) >= min(usable, 4) or len(same) >= min(len(t) - k + 1, 4)

    want = {(d, i) for d, x in docs for i, y in items if holds(x, y)}
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(make(docs), b).collect()}
    assert got == want and sum(d < 200 for d, _ in want) >= 10 and sum(200 <= d < 300 for d, _ in want) < 12


def test_decontamination_finds_all_literal_leaks(spark):
    """Every document that holds eight words of an item in a row, by brute force, and none without three of five."""
    import re

    words = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    docs, items = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "benchmark"))
    grams = {}
    for r in items.collect():
        w = words.findall(r["text"].lower())
        for k in range(len(w) - 7):
            grams.setdefault(tuple(w[k : k + 8]), set()).add(r["item_id"])
    want = set()
    for r in docs.collect():
        w = words.findall(r["text"].lower())
        for k in range(len(w) - 7):
            want |= {(r["doc_id"], i) for i in grams.get(tuple(w[k : k + 8]), ())}
    assert {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(docs, items).collect()} == want


def test_pipeline(spark):
    import corpus_pipeline as C

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert [n for n, _ in C.STAGES] == ["toxicity", "ngram_join", "decontamination", "mixing", "sharding"]
    seen = docs
    for name, stage in C.STAGES[:-1]:
        out = stage(spark, seen, DATA)
        assert out.columns == docs.columns, name
        ids = {r["doc_id"] for r in out.select("doc_id").collect()}
        assert ids <= {r["doc_id"] for r in seen.select("doc_id").collect()}
        if name != "mixing":
            assert out.count() == len(ids)
        seen = out.cache()
    final = C.STAGES[-1][1](spark, seen, DATA)
    assert final.count() == seen.count()
    assert C.run(spark, DATA).count() == final.count()


def test_pipeline_on_odd_tables(make, spark, tmp_path):
    """Null ids and texts, repeated rows, extra columns; and no rows at all."""
    import corpus_pipeline as C

    words = [f"w{k}" for k in range(400)]
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(words) for _ in range(60)), "en", rng.choice(["a", None, "b"])) for i in range(60)]
    rows += [(None, None), (None, ""), (70, None), (71, "")] + [rows[3]] * 4 + [(None, rows[5][1], "en", "a")] * 3 + [(80, rows[7][1] + " and more", "en", "b"), (81, ITEMS[0][1] + " " + rows[9][1])]
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, int(i % 9 == 0)) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for part, some in (("full", rows), ("none", [])):
        seen = make(some).cache()
        for name, stage in C.STAGES[:-1]:
            out = stage(spark, seen, str(tmp_path)).cache()
            assert out.columns == seen.columns, name
            ids = [(r["doc_id"], r["text"]) for r in out.collect()]
            assert set(ids) <= {(r["doc_id"], r["text"]) for r in seen.collect()}, name
            if name == "ngram_join" and some:
                assert (None, rows[5][1]) not in ids and len(ids) == len(set(ids)) and not any(d == 80 and (7, rows[7][1]) in ids for d, _ in ids)
            if name == "decontamination" and some:
                assert 81 not in {d for d, _ in ids}
            seen = out
        assert C.STAGES[-1][1](spark, seen, str(tmp_path)).count() == seen.count()


def test_sql_agrees(spark):
    import duckdb

    from fernglass.llm import line_dedup, mixing

    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{DATA}/documents.parquet'")
    for op, sql in ((mixing.op1, mixing.SQL), (line_dedup.op3, line_dedup.SQL)):
        got = op(spark, DATA).toPandas().sort_values("doc_id").reset_index(drop=True)
        want = con.execute(sql).df().sort_values("doc_id").reset_index(drop=True)[list(got.columns)]
        assert all((got[c] == want[c]).all() for c in got.columns)
