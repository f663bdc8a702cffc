"""Operators with an exact meaning, against brute force on small and odd inputs."""

import hashlib
import math
import random
import re
import zlib

import pytest

from fernglass.llm import components, license_scan, line_dedup, media, mixing, ngram_join, sharding, suffix_dedup
from fernglass.llm import textarrays as A

WORD = re.compile("[^\x20\x09-\x0d]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def corpus(seed=3, n=60):
    """Near copies, copies, shared passages, short, empty and null texts, non-ASCII, a null id, a repeated row, a long text."""
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    say = lambda k: [rng.choice(vocab) for _ in range(k)]
    passage = " ".join(say(20))
    rows, base = [], say(140)
    for i in range(n):
        kind = i % 6
        if kind == 0:
            w = list(base)
            for _ in range(rng.randint(0, 6)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            text = " ".join(w)
        elif kind == 1:
            text = " ".join(base[:90])
        elif kind == 2:
            text = " ".join(say(30)) + "\n" + passage + "\n" + " ".join(say(10))
        elif kind == 3:
            text = "\n".join(rng.choice(["Line A is here", "line b", "  ", "The third line", "x y"]) for _ in range(rng.randint(0, 9)))
        elif kind == 4:
            text = " ".join(say(rng.randint(0, 7))).upper()
        else:
            text = " ".join(say(rng.randint(40, 400)))
        rows.append((i, text))
    rows += [(900, None), (901, ""), (902, " \n\t "), (None, "text of a null id " + passage), (903, rows[5][1]), (904, rows[0][1]), (904, rows[0][1]), (905, "ab" * 9000), (906, "ab" * 9000 + "!")]
    return rows


@pytest.fixture(scope="module")
def docs(make):
    return make(corpus()).repartition(3).cache()


def key(i):
    return -1 if i is None else i


def collect(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=lambda t: tuple((x is not None, x) for x in t))


def test_words_and_shingles():
    texts = ["a b  c", "", "d", " e\tf\x0bg é ", "x" * 70]
    data = "".join(texts).encode()
    import numpy as np

    off = np.cumsum([0, *(len(t.encode()) for t in texts)])
    arr = np.frombuffer(data, np.uint8)
    s, e, first = A.words(arr, off)
    found = [[data[a:b].decode() for a, b in zip(s[first[i] : first[i + 1]], e[first[i] : first[i + 1]])] for i in range(len(texts))]
    assert found == [WORD.findall(t) for t in texts]
    h, at = A.shingles(A.Prefix(arr).of(s, e), first, 3)
    assert list(map(int, (at[1:] - at[:-1]))) == [1, 0, 1, 2, 1]
    v = np.array([5, 3, 9, 1, 1, 7, 2], np.uint64)
    for w in range(1, 8):
        assert A.window_min(v, w).tolist() == [min(v[i : i + w]) for i in range(len(v) - w + 1)]


def test_mixing(docs):
    rows = corpus()
    size = lambda t: len(WORD.findall(t or ""))
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    total = sum(size(t) for _, t in rows)
    assert all(r["source_size"] == total and math.isclose(r["target"], 1.5 * total) and r["copies"] in (1, 2) for r in got)
    taken = sum(r["copies"] * r["size"] for r in got)
    assert abs(taken - 1.5 * total) < 0.03 * total
    assert collect(mixing.mix(docs), "doc_id", "copies") == collect(mixing.mix(docs), "doc_id", "copies")


def test_mixing_targets(make):
    rows = [(i, "w " * 10, "en", ["a", "b", "c", None][i % 4]) for i in range(40)] + [(99, "w " * 400, "en", "big"), (100, None, "en", "empty")]
    t = {r["source"]: r for r in mixing.source_targets(mixing.sizes(make(rows))).collect()}
    # sources by code point: a b big c empty null with weights 3 1 2 3 1 2
    assert [t[s]["weight"] for s in ("a", "b", "big", "c", "empty", None)] == [3, 1, 2, 3, 1, 2]
    sizes = {s: t[s]["source_size"] for s in t}
    total = 1.5 * sum(sizes.values())
    want = dict.fromkeys(t, 0.0)
    open_ = set(t)
    left = total
    while True:  # the excess reshared until none is above
        w = sum(t[s]["weight"] for s in open_)
        over = {s for s in open_ if left * t[s]["weight"] / w > 2 * sizes[s]}
        if not over:
            for s in open_:
                want[s] = left * t[s]["weight"] / w
            break
        for s in over:
            want[s] = 2.0 * sizes[s]
            left -= want[s]
        open_ -= over
    assert {s: round(t[s]["target"], 6) for s in t} == {s: round(x, 6) for s, x in want.items()}


def test_emit_keeps_columns(docs):
    out = mixing.emit(docs)
    assert out.columns == docs.columns
    drawn = {}
    for r in mixing.mix(docs).collect():
        drawn[r["doc_id"]] = drawn.get(r["doc_id"], 0) + r["copies"]  # a repeated row has a draw of its own
    per = {}
    for r in out.collect():
        per[r["doc_id"]] = per.get(r["doc_id"], 0) + 1
    assert {i: n for i, n in drawn.items() if n} == per


def brute_components(rows):
    sets = []
    for _, t in rows:
        w = WORD.findall((t or "").translate(LOW))
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n and 100 * n >= 75 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if sets[i]:
            ids = least.setdefault(find(i), [])
            ids.append(d)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [x for x in least.get(find(i), []) if x is not None] if sets[i] else [d]
        out.append((d, len(sets[i]), min(ids) if ids and ids[0] is not None else (ids[0] if ids else None)))
    return sorted(out, key=lambda t: tuple((x is not None, x) for x in t))


@pytest.mark.parametrize("seed", [3, 11])
def test_jaccard_components(make, seed):
    rows = corpus(seed)
    got = ngram_join.jaccard_components(make(rows))
    assert collect(got, "doc_id", "n_shingles", "component_id") == brute_components(rows)


def test_jaccard_at_the_threshold(make):
    rows = []
    for n in (4, 40, 85, 200, 400):  # pairs with exactly 75 and just under 75 of 100
        shared = [f"w{n}x{k}" for k in range(3 * n + 4)]
        for extra in (n, n + 1):
            at = 10 * len(rows)
            rows += [(at, " ".join(shared)), (at + 1, " ".join(shared + [f"e{n}y{extra}z{k}" for k in range(extra)]))]
    assert collect(ngram_join.jaccard_components(make(rows)), "doc_id", "n_shingles", "component_id") == brute_components(rows)


def test_jaccard_blocks_and_chains(make, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    rng = random.Random(1)
    w = [f"t{k}" for k in range(200)]
    rows = []
    for i in range(40):  # a chain: neighbours link, ends don't
        rows.append((i, " ".join(w)))
        for _ in range(2):
            w[rng.randrange(200)] = f"n{i}{rng.random()}"
    assert collect(ngram_join.jaccard_components(make(rows)), "doc_id", "n_shingles", "component_id") == brute_components(rows)


def test_one_of_each(docs):
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns
    want = {d for d, _, c in brute_components(corpus()) if d == c}
    assert {r["doc_id"] for r in kept.collect()} == want


def test_emit_counts_every_row(make):
    rows = [(None if i % 2 else i, f"text {'w ' * (i // 3 % 9)}{i}", "en", "abc"[i % 3]) for i in range(300)] + [(900, "again", "en", "b")] * 7
    docs = make(rows).repartition(3).cache()
    m = mixing.mix(docs).collect()
    want, got = {}, {}
    for r in m:  # equal rows may swap their numbers, so per source and size
        want[(r["source"], r["size"])] = want.get((r["source"], r["size"]), 0) + r["copies"]
    for r in mixing.emit(docs).collect():
        at = (r["source"], len(WORD.findall(r["text"])))
        got[at] = got.get(at, 0) + 1
    assert got == {k: n for k, n in want.items() if n}
    assert any(0 < r["rate"] < 1 for r in m) and any(r["copies"] == 0 and r["doc_id"] is None for r in m)


def test_one_row_of_each_component(make):
    a, b, c = (" ".join(f"{x}{k}" for k in range(200)) for x in "abc")
    near = lambda t, i: f"{t} and the end {i}"
    rows = [(5, a), *((None, near(a, i)) for i in range(4))]  # the null ids are copies of 5
    rows += [(None, near(b, i)) for i in range(4)] + [(None, near(b, 0))] * 2  # no id in the component
    rows += [(7, c), (7, near(a, 9)), (8, near(c, 1))]  # 7 stands for c only
    rows += [(None, None), (None, None), (None, " "), (9, ""), (9, "")]  # without words
    got = [(r["doc_id"], r["text"]) for r in ngram_join.one_of_each(make(rows).repartition(3)).collect()]
    worded = [x for x in got if x[1] and x[1].strip()]
    assert len(worded) == 3 and (5, a) in worded and (7, c) in worded
    assert [d for d, t in worded if t.startswith("b0 ")] == [None]
    assert len(got) - len(worded) == 5


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 105), (105, 101), (7, 7), (200, 200)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert {n for n, r in got.items() if r == 0} == set(range(31)) and {n for n, r in got.items() if r == 100} == {100, 101, 105}


def brute_lines(rows, run=3, long=50):
    places, seqs = {}, {}
    for d, t in sorted({(key(d), t) for d, t in rows if t is not None}):
        lines = t.split("\n")
        at = [i for i, x in enumerate(lines) if WORD.search(x)]
        wins = []
        for k in range(len(at)):
            words, n = 0, 0
            while n < run and words < long and k + n < len(at):
                words += len(WORD.findall(lines[at[k + n]]))
                n += 1
            enough = n == run or words >= long
            if enough or k == 0:
                wins.append((k, (not enough, *(lines[i] for i in at[k : k + n]))))
        seqs[(d, t)] = (lines, at, wins)
        for k, w in wins:
            places.setdefault(w, []).append((d, k, t))
    out = []
    for d, t in rows:
        lines, at, wins = seqs.get((key(d), t), ([""], [], []))
        drop = set()
        for k, w in wins:
            first = min(places[w], key=lambda p: (p[0], p[1]))
            if (first[0], first[1]) < (key(d), k):
                drop |= set(range(k, k + len(w) - 1))
        kept = "\n".join(x for i, x in enumerate(lines) if i not in {at[k] for k in drop})
        out.append((d, len(at), len(drop), sum(k - 1 not in drop for k in drop), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=lambda t: tuple((x is not None, x) for x in t))


def test_line_dedup_of_short_and_long_lines(make):
    long, half = " ".join(f"w{k}" for k in range(60)), " ".join(f"h{k}" for k in range(27))
    rows = [(1, f"a b\n{long}\nc"), (2, f"x\n{long}\ny z\nq"), (3, long), (4, long), (5, f"{half}\n{half}2"), (6, f"k\n{half}\n{half}2\nm"), (7, half), (8, f"m\n{half}"), (9, half), (10, "two\nlines"), (11, "two\nlines"), (12, "two"), (13, "two\nlines\n \n"), (14, "\n\n"), (15, "u\nu\nu\nu")]
    got = line_dedup.dedup_lines(make(rows))
    assert collect(got, "doc_id", "n_lines", "n_removed", "n_runs", "kept_sha256") == brute_lines(rows)
    gone = {r["doc_id"]: r["n_removed"] for r in got.collect()}
    assert gone == {1: 0, 2: 1, 3: 1, 4: 1, 5: 0, 6: 2, 7: 0, 8: 0, 9: 1, 10: 0, 11: 2, 12: 0, 13: 2, 14: 0, 15: 3}


def test_line_dedup(docs):
    got = line_dedup.dedup_lines(docs)
    assert collect(got, "doc_id", "n_lines", "n_removed", "n_runs", "kept_sha256") == brute_lines(corpus())
    kept = line_dedup.dedup_lines(docs, keep=True).collect()
    assert all(hashlib.sha256(r["kept"].encode()).hexdigest() == r["kept_sha256"] for r in kept)


def brute_repeats(rows, length=50):
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - length + 1):
            g = b[p : p + length]
            first[g] = min(first.get(g, key(d)), key(d))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] < key(d):
                gone[p : p + length] = b"\1" * length
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=lambda t: tuple((x is not None, x) for x in t))


def test_suffix_dedup(docs):
    got = suffix_dedup.remove_repeats(docs, keep=True)
    assert collect(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_repeats(corpus())
    assert all(hashlib.sha256(bytes(r["kept"])).hexdigest() == r["kept_sha256"] for r in got.collect())


def test_family_of_levels():
    import numpy as np

    rng = np.random.default_rng(0)
    family, seen = suffix_dedup.Family(), {}
    for d in range(40):
        keys = rng.integers(0, 500, 50, dtype=np.uint64)
        got = family.add(keys, np.full(50, d, np.int64))
        for k in keys.tolist():
            seen.setdefault(k, d)
        assert got.tolist() == [seen[k] for k in keys.tolist()]
    sizes = [len(k) for k, _ in family.levels]
    assert all(a >= 2 * b for a, b in zip(sizes, sizes[1:])) and len(sizes) < 8


def test_media_round_trip(docs):
    rows = {key(d): t for d, t in corpus()}
    got = media.media_columns(docs, keep_media=True).collect()
    features = {}
    for r in got:
        text = (rows[key(r["doc_id"])] or "").encode()
        padded = text + b"\0" * (max(64, -(-len(text) // 64) * 64) - len(text))
        assert media.from_wav(bytes(r["media"])) == padded
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(text), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        assert r["media_sha256"] == hashlib.sha256(bytes(r["media"])).hexdigest() and r["media_bytes"] == len(r["media"])
        assert features.setdefault(text, r["feature"]) == r["feature"]
        assert r["landmark_time"] == sorted(r["landmark_time"]) and len(r["landmark_hash"]) == r["n_landmarks"]
    assert len(got) == len(corpus())


def test_spectral_peaks_find_a_tone():
    import numpy as np

    t = np.arange(4096)
    tone = (128 + 100 * np.sin(2 * np.pi * t * 32 / 256)).astype(np.uint8).tobytes()
    _, h = media.fingerprint(tone)
    assert set((h >> 16).tolist()) <= {31, 32, 33} and len(h)
    a, b = media.fingerprint(tone * 3, piece=2048), media.fingerprint(tone * 3)
    assert a[0].tolist() == b[0].tolist() and a[1].tolist() == b[1].tolist()


LICENSES = [
    (1, "This work is licensed under the GNU General Public License, version 3."), (2, "GNU general public license gnu General PUBLIC license"), (3, "Apache license; Licensed under the Apache License, Version 2.0."),
    (4, "the MIT-license and mit license"), (5, "gnu general license public mit"), (6, None), (7, ""), (8, "CC BY-NC 4.0"), (9, "Licensed under CC BY-NC 4.0."), (10, "mit " * 500 + "license"), (None, "cc by"), (2, "nothing é"),
    (11, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
]


def test_license_scan(make):
    words = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    want = []
    for d, t in LICENSES:
        w = words.findall((t or "").translate(LOW))
        places, labels = [], set()
        for phrase, label in license_scan.BASE.items():
            p = phrase.split()
            at = [k for k in range(len(w) - len(p) + 1) if w[k : k + len(p)] == p]
            places += at
            labels |= {label} if at else set()
        want.append((d, len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))))
    got = license_scan.scan(make(LICENSES))
    assert collect(got, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == sorted(want, key=lambda t: tuple((x is not None, x) for x in t))
    labels = {r["doc_id"]: r["labels"] for r in got.collect() if r["doc_id"] not in (2, None)}
    assert labels[1] == "gpl,gpl-3.0" and labels[3] == "apache,apache-2.0" and labels[9] == "cc-by,cc-by-nc-4.0" and labels[11] == "mit-grant" and labels[6] == ""
    assert all(0 <= r["score"] <= 1 for r in got.collect())


def brute_license(rows):
    """labels and score: every template at every alignment."""
    find = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(LOW))
    index, n = license_scan.phrases(), len(rows)
    have = [set(find(t)) for _, t in rows]
    idf = {w: math.log((n + 1) / (sum(w in x for x in have) + 0.5)) for w in license_scan.vocabulary()}
    names, out = [*license_scan.BASE.values(), *license_scan.TEMPLATES], []
    for d, t in rows:
        w, labels, score = find(t), set(), 0.0
        for k, (ws, a, b) in enumerate(index):
            for start in range(-len(ws), len(w)):
                at = [0 <= start + j < len(w) and w[start + j] == x for j, x in enumerate(ws)]
                if all(at[a:b]):
                    share = 1.0 if k < len(license_scan.BASE) else sum(idf[x] for x, y in zip(ws, at) if y) / sum(idf[x] for x in ws)
                    score = max(score, share)
                    if share >= 0.75:
                        labels.add(names[k])
        out.append((d, ",".join(sorted(labels)), round(min(1.0, score), 9)))
    return sorted(out, key=lambda t: tuple((x is not None, x) for x in t))


def test_license_labels_and_score_by_brute_force(make):
    rng = random.Random(6)
    rows = list(LICENSES)
    for i, (text, _) in enumerate(license_scan.TEMPLATES.values()):
        w = text.split()
        rows.append((100 + i, f"# {text}\n# more of the work"))
        for at in rng.sample(range(len(w)), min(2, len(w))):
            w[at] = rng.choice(["other", "word", "é"])
        rows += [(200 + i, "x y " + " ".join(w)), (300 + i, " ".join(text.split()[3:])), (400 + i, f"plain words {i} for the rest of it"), (500 + i, "\n// ".join([text] * 3))]
    got = license_scan.scan(make(rows)).collect()
    assert sorted(((r["doc_id"], r["labels"], round(r["score"], 9)) for r in got), key=lambda t: tuple((x is not None, x) for x in t)) == brute_license(rows)
    assert sum(bool(r["labels"]) for r in got) > 40


def test_license_without_its_rarest_word(make):
    texts = ["according to the terms of the Mozilla Public License, v. 2.0", "Permision is hereby granted, free of charge, to any person obtaining a copy of this software", "The usage and use in source and binary forms, with or without modification, are permitted"]
    rows = list(enumerate(texts)) + [(100 + i, f"ordinary text {i}") for i in range(30)]
    got = {r["doc_id"]: r for r in license_scan.scan(make(rows)).collect()}
    assert [got[i]["labels"] for i in range(3)] == ["mpl-2.0", "mit-grant", "bsd"] and all(0.75 <= got[i]["score"] < 1 for i in range(3))
    assert got[100]["labels"] == "" and got[100]["score"] == 0


def test_sharding(docs):
    rows = corpus()
    got = sharding.shard(docs, rows_per_range=4).collect()
    assert len(got) == len(rows)
    total = sum(len((t or "").encode()) + 1 for _, t in rows)
    most = max(len((t or "").encode()) + 1 for _, t in rows)
    per, crc = {}, {}
    for d, t in rows:
        crc.setdefault(d, []).append((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())))
    for r in got:
        assert (r["size"], r["text_crc32"]) in crc[r["doc_id"]] and r["law"] == "bytes" and r["grown_shard"] is None
        per.setdefault(r["shard"], []).append((r["slot"], r["size"]))
    assert all(sorted(s for s, _ in x) == list(range(len(x))) for x in per.values())
    assert all(abs(sum(z for _, z in x) - total / 16) <= most for x in per.values())


def test_hot_text_is_spread(make):
    rows = [(i, "the very same text") for i in range(400)] + [(1000 + i, f"text {i}") for i in range(100)]
    got = sharding.shard(make(rows), rows_per_range=8).collect()
    sizes = {}
    for r in got:
        sizes[r["shard"]] = sizes.get(r["shard"], 0) + r["size"]
    assert set(sizes) == set(range(16)) and max(sizes.values()) - min(sizes.values()) <= 2 * 19


def test_groups_of_equal_texts_stay_whole(make):
    rng = random.Random(4)
    texts = [f"{k} " + "word " * rng.randint(1, 60) for k in range(2500)]
    rows = [(i, texts[i % 2500]) for i in range(7500)]
    got = sharding.shard(make(rows).repartition(3), rows_per_range=64).collect()
    shards, sizes, slots = {}, [0] * 16, {}
    for r in got:
        shards.setdefault((r["size"], r["text_crc32"]), set()).add(r["shard"])
        sizes[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(len(x) == 1 for x in shards.values()) and max(sizes) - min(sizes) < 0.06 * sum(sizes) / 16
    assert all(sorted(x) == list(range(len(x))) for x in slots.values()) and len(got) == len(rows)


def test_overfull_ranges_are_subdivided(make):
    from pyspark.sql import functions as F

    keyed = make([(i, "x") for i in range(600)]).select(F.lit(1).cast("long").alias("__k1"), F.col("doc_id").alias("__k2"), F.when(F.col("doc_id") < 30, 1000).otherwise(1).cast("long").alias("size"))
    _, ranges = sharding.split_ranges(keyed, 20, 64)
    total = sum(b for _, b, _ in ranges)
    assert max(b for _, b, _ in ranges) <= 2 * total / 32 + 1000 and sum(n for _, _, n in ranges) == 600


@pytest.mark.parametrize("doc_id", [7, None])
def test_rows_of_one_key_are_all_placed(make, doc_id):
    rows = [(doc_id, "the very same text")] * 4000 + [(1000 + i, f"text {i}") for i in range(8000)]
    got = sharding.shard(make(rows).repartition(4)).collect()
    assert len(got) == len(rows)
    per = {}
    for r in got:
        per.setdefault(r["shard"], []).append((r["slot"], r["size"]))
    assert set(per) == set(range(16)) and all(sorted(s for s, _ in x) == list(range(len(x))) for x in per.values())
    total = sum(len(t) + 1 for _, t in rows)
    assert all(abs(sum(z for _, z in x) - total / 16) <= 19 for x in per.values())


def test_ranges_of_one_key_are_final(make):
    from pyspark.sql import functions as F

    keyed = make([(i // 3 * 3 if i > 400 else 7, "x") for i in range(1200)]).select(F.lit(1).cast("long").alias("__k1"), F.col("doc_id").alias("__k2"), F.lit(5).cast("long").alias("size"))
    splitters, ranges = sharding.split_ranges(keyed, 8, 256)
    assert sum(n for _, _, n in ranges) == 1200 and sum(b for _, b, _ in ranges) == 6000 and all(r <= len(splitters) for r, _, _ in ranges)
    at = sharding.range_of(splitters, 2)(F.struct("__k1", "__k2"))
    found = keyed.groupBy(at.alias("r")).agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n"))
    assert sorted(tuple(r) for r in found.collect()) == ranges


@pytest.mark.parametrize("f", [mixing.mix, ngram_join.jaccard_components, line_dedup.dedup_lines, media.media_columns, suffix_dedup.remove_repeats, license_scan.scan, sharding.shard, mixing.emit, ngram_join.one_of_each])
def test_empty_table(make, f):
    assert f(make([])).count() == 0


def test_all_null_texts(make):
    rows = [(1, None), (2, None), (None, None)]
    for f in (mixing.mix, ngram_join.jaccard_components, line_dedup.dedup_lines, media.media_columns, suffix_dedup.remove_repeats, license_scan.scan, sharding.shard):
        assert f(make(rows)).count() == 3


def thue_morse(n, flip=False):
    x = [0]
    while len(x) < n:
        x += [1 - b for b in x]
    return "".join("ab"[b ^ flip] for b in x[:n])


@pytest.mark.parametrize("n", [1024, 4096])
def test_hashes_tell_thue_morse_words_apart(make, n):
    """Words, lines and passages that defeat polynomial hashes modulo powers of two."""
    a, b = thue_morse(n), thue_morse(n, True)
    tail = " one two three four five six seven eight nine ten eleven twelve"
    rows = [(1, a), (2, b), (3, a + tail), (4, b + tail), (5, f"{a}\nx1 y\nx2 z"), (6, f"{b}\nx1 y\nx2 z"), (7, a)]
    assert collect(ngram_join.jaccard_components(make(rows)), "doc_id", "n_shingles", "component_id") == brute_components(rows)
    assert collect(line_dedup.dedup_lines(make(rows)), "doc_id", "n_lines", "n_removed", "n_runs", "kept_sha256") == brute_lines(rows)
    assert collect(suffix_dedup.remove_repeats(make(rows)), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_repeats(rows)


def test_exact_candidates_find_no_other_links(make):
    """Large sets near the threshold: bands lose nothing that prefixes for all sizes find."""
    rng, rows = random.Random(5), []
    for g in range(12):
        base = [f"g{g}w{k}" for k in range(rng.choice([130, 161, 200, 320]))]
        for i in range(4):
            w = list(base)
            for _ in range(rng.randint(0, 9)):
                w[rng.randrange(len(w))] = f"n{rng.random()}"
            rows.append((100 * g + i, " ".join(w)))
    want = brute_components(rows)
    for exact in (False, True):
        assert collect(ngram_join.jaccard_components(make(rows), exact), "doc_id", "n_shingles", "component_id") == want


def test_a_passage_in_all_documents_is_asked_for_once_a_batch():
    import numpy as np

    rng = np.random.default_rng(3)
    keys = np.r_[np.full(500, 7), rng.integers(100, 1 << 60, 500)].astype(np.uint64)
    doc = np.r_[np.arange(500), np.arange(500)]
    known = suffix_dedup.decided(keys, doc)
    assert (known[1:500] == suffix_dedup.COVERED).all() and known[0] == suffix_dedup.ASK and (known[500:] == suffix_dedup.ASK).all()
    rows = suffix_dedup.message_rows(doc, doc.astype(np.uint64), np.arange(1000) % 500, keys, keys, 4, 1)
    assert sum(len(r[6]) // 8 for r in rows if r[1] < 0) == 501
    none = suffix_dedup.decided(np.full(9, 5, np.uint64), np.full(9, suffix_dedup.LOWEST))
    assert sorted(none.tolist()) == [suffix_dedup.ASK] + [suffix_dedup.FREE] * 8


def test_suffix_dedup_of_common_passages_and_repeated_rows(make):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(5))
    passage, other = (" ".join(word() for _ in range(14)) for _ in range(2))
    rows = []
    for i in range(120):
        d = None if i % 4 == 0 else i // 2 if i % 4 == 1 else 40 if i % 4 == 2 else i
        rows.append((d, f"{word()} {word()}{passage if i % 3 else other} {word()} {passage[10:] if i % 5 == 0 else ''} {word()}"))
    rows += [(40, rows[2][1])] * 7 + [(None, rows[0][1])] * 5
    got = suffix_dedup.remove_repeats(make(rows).repartition(5))
    assert collect(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_repeats(rows)


def test_hot_keys_are_spread_in_a_join(spark):
    from pyspark.sql import functions as F

    from fernglass.llm.common import unskewed_join

    big = spark.range(6000).select(F.when(F.col("id") < 4000, F.lit(7)).otherwise(F.col("id")).alias("k"), "id")
    small = big.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("m")).where("n > 1 or k % 2 = 0")
    for how in ("inner", "left_semi"):
        got, want = unskewed_join(big, small, "k", "n", ["id"], how), big.join(small, "k", how)
        assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
        assert "__salt" in got._jdf.queryExecution().optimizedPlan().toString()


def test_line_that_stands_everywhere(make):
    rows = [(i, f"the very common line\nand another of them\nand a third one\nown {i}\n" + ("the very common line\n" if i % 3 else "")) for i in range(1500)]
    assert collect(line_dedup.dedup_lines(make(rows)), "doc_id", "n_lines", "n_removed", "n_runs", "kept_sha256") == brute_lines(rows)


def test_a_worker_holds_no_free_memory_after_its_rows():
    import pyarrow as pa

    from fernglass.llm import common

    def resident():
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * 4096

    pinned, sizes = [], []

    def rows(batches):
        for b in batches:
            held = [bytes(2000) for _ in range(60_000)]
            pinned.append(bytes(3000))  # stands above what is freed, so the heap's end can't move down
            yield len(held) + b
        del held
        sizes.append(resident())

    assert list(common.lean(rows)(iter([1]))) == [60_001]
    assert sizes[0] - resident() > 60_000_000
    got = common.lean_groups(lambda key, t: t, least=1)((1,), pa.table({"a": [1, 2]}))
    assert got.num_rows == 2


@pytest.mark.parametrize("hot", [1 << 16, 3])
def test_undecided_runs_travel_as_bytes_or_by_string(make, monkeypatch, hot):
    """Common phrases shorter than a string among ever new words, and passages that repeat but for a few words."""
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))
    phrases, long = [" ".join(word() for _ in range(5)) for _ in range(4)], [word() for _ in range(60)]
    rows = []
    for i in range(90):
        w = list(long)
        for _ in range(6):
            w[rng.randrange(60)] = word()
        rows.append((None if i % 9 == 0 else i // 2, " ".join([word(), rng.choice(phrases), word(), *w[: rng.randint(0, 60)], rng.choice(phrases), word()])))
    rows += rows[20:24]
    got = suffix_dedup.remove_repeats(make(rows).repartition(4))
    assert collect(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_repeats(rows)


def test_messages_hold_few_bytes_per_text_and_undecided_run():
    import numpy as np

    rng, parts, n = np.random.default_rng(5), 64, 2000
    doc = np.arange(n) + 10**9
    mark = rng.integers(0, 1 << 63, n).astype(np.uint64)
    text = np.repeat(np.arange(n), 100)
    keys = rng.integers(0, 1 << 63, len(text)).astype(np.uint64)
    keys[text % 2 == 1] = keys[text % 2 == 0]  # half of it is decided within the batch
    size = lambda rows: sum(len(x) for r in rows for x in r if isinstance(x, bytes))
    rows = suffix_dedup.message_rows(doc, mark, text, keys, keys, parts, 1)
    assert len(rows) == parts + 1
    asked, pairs = len(text) // 2, sum(len(r[4]) // 8 for r in rows if r[1] < 0)
    assert size(rows) < 12 * asked + 12 * pairs + 20 * n
    words = b" ".join(b"%d" % x for x in rng.integers(100, 999, 30_000))
    data = np.frombuffer(words, np.uint8)[: 80 * 1000]
    runs = np.repeat(np.arange(200), 5)
    sent = suffix_dedup.context_rows(doc, mark, runs, keys[:1000], np.full(1000, 80), data, parts, 1)
    assert size(sent) < 31 * 1000 * 8 / 3
    by_part = [(r, suffix_dedup.context_keys(np.frombuffer(suffix_dedup.zstandard.decompress(r[6]), np.uint8), suffix_dedup.opened(r[7], np.uint8).astype(np.int64))) for r in sent]
    assert sum(len(k) for _, k in by_part) == 31_000 and all(suffix_dedup.opened(r[5], np.uint32).sum() == len(k) for r, k in by_part)
    some = np.array([5, -(1 << 63), 7, (1 << 63) - 1, -3])
    assert suffix_dedup.unstepped(suffix_dedup.steps(some)).tolist() == some.tolist()


def test_shuffle_files_go_with_the_plan_that_is_cut(spark):
    from pyspark.sql import functions as F

    from fernglass.llm.common import cut_and_free

    def files():
        blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks().mkString(" ").split()
        return {b for b in blocks if b.startswith("shuffle_")}

    before = files()
    got = cut_and_free(spark.range(5000).groupBy((F.col("id") % 100).alias("k")).agg(F.count(F.lit(1)).alias("n")))
    assert not files() - before
    assert got.count() == 100 and got.agg(F.sum("n")).first()[0] == 5000
