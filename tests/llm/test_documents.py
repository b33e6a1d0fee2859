"""Fingerprints, statistics, token files, scores, languages, mixes and leaks against plain versions, and odd rows."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from quillspark.llm import common, decontam, langid, mixing, quality, simhash, tokens, toxicity
from quillspark.llm.components import connected_components

SCHEMA = "doc_id long, text string, lang string, source string, fp int, words string, size string"
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def rows(texts, lang="en", source=None):
    return [(i, t, lang, source or f"s{i % 3}", 1, "clash", "clash") for i, t in enumerate(texts)]


def frame(spark, r):
    return spark.createDataFrame(r, SCHEMA)


ODD = [(900, None, None, None, 1, "c", "c"), (901, "", "en", "s1", 1, "c", "c"), (902, " \t\x0b", None, "s0", 1, "c", "c"), (902, " \t\x0b", None, "s0", 1, "c", "c"), (None, "one two three four", "en", "s1", 1, "c", "c"), (903, "é" * 5000 + " ok", "fr", "é", 1, "c", "c")]


def prose(seed, n, words=40):
    r = random.Random(seed)
    v = ["".join(r.choice(["th", "er", "on", "an", "re", "he", "in"]) for _ in range(r.randint(1, 3))) for _ in range(400)]
    return [" ".join(r.choice(v) for _ in range(r.randint(1, words))) for _ in range(n)]


def plain_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    g = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in g]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_near_duplicates(spark):
    texts = prose(1, 60) + [" ".join(["alpha beta gamma delta"] * 30)] * 5
    base = prose(2, 1, 60)[0] + " " + prose(3, 1, 60)[0]
    texts += [base.replace(" ", f" w{i} ", 1) for i in range(60)] + ["", None, "ÀÉ A b"]
    d = frame(spark, rows(texts) + ODD)
    got = simhash.near_duplicates(d).collect()
    fps = {r["doc_id"]: r["fp"] % (1 << 64) for r in got}
    source = {r["doc_id"]: r["text"] for r in d.collect()}
    assert len(got) == d.count() and all(fps[i] == plain_fingerprint(source[i]) for i in fps)
    ids = sorted(i for i in fps if i is not None)
    root = {i: i for i in ids}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= 2 and top(a) != top(b):
                root[max(top(a), top(b))] = min(top(a), top(b))
    assert all(r["component_id"] == top(r["doc_id"]) for r in got if r["doc_id"] is not None)


@pytest.mark.parametrize("blocks", [4, 6])
def test_links_in_full_cells(spark, blocks):
    """Fingerprints around one centre, more than a cell may pair, are linked as brute force links them."""
    r = random.Random(blocks)
    center = r.getrandbits(64)
    values = sorted({center ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 3))) for _ in range(300)} | {r.getrandbits(64) for _ in range(100)})
    nodes = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v, i) for i, v in enumerate(values)], "fp long, rep long")
    root = {x["node"]: x["root"] for x in connected_components(simhash.links(nodes, blocks)).collect()}
    want = list(range(len(values)))
    for i, a in enumerate(values):
        for j in range(i):
            if (a ^ values[j]).bit_count() <= 2:
                x, y = want[i], want[j]
                want = [min(x, y) if w in (x, y) else w for w in want]
    assert [root.get(i, i) for i in range(len(values))] == want


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([(1, 1), (None, 2)], "u long, v long")).collect() == []


def plain_statistics(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    seen, covered = Counter(windows), set()
    for i, x in enumerate(windows):
        if seen[x] > 1:
            covered.update(range(i, i + 5))
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_statistics(spark):
    r = random.Random(4)
    texts = ["".join(r.choice(["a ", "b ", "c\n", "a b c d e ", "x#", "\n", "é𝄞 ", "<|> ", "\x0b"]) for _ in range(r.randint(0, 60))) for _ in range(150)] + ["w " * 3000]
    d = frame(spark, rows(texts) + ODD)
    judged = quality.judge(d, []).collect()
    source = {x["doc_id"]: x["text"] for x in d.collect()}
    assert len(judged) == d.count()
    for x in judged:
        n, chars, symbols, lines, repeated = plain_statistics(source[x["doc_id"]])
        assert (x["n_words"], x["word_chars"], x["n_symbols"], x["n_dup_lines"], x["n_repeat_words"]) == (n, chars, symbols, lines, repeated)
        assert x["base_failed"] == (n < 10 or 100 * repeated > 20 * n) and x["kept"] == (not x["base_failed"])


def test_rules_learn_the_bad(spark):
    good, bad = prose(5, 300), [" ".join(w + "###" for w in t.split()) for t in prose(6, 100)]
    d = frame(spark, rows([t + " some more words to be long enough here now and then" for t in good + bad]))
    labels = spark.createDataFrame([(i, int(i < 300), 0) for i in range(400)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    rules = quality.fit(d, labels)
    kept = {x["doc_id"]: x["kept"] for x in quality.judge(d, rules).collect()}
    assert rules and sum(kept[i] for i in range(300)) >= 295 and sum(kept[i] for i in range(300, 400)) <= 5
    assert quality.fit(d, labels.limit(0)) == []


def test_token_files(spark):
    r = random.Random(7)
    texts = prose(8, 40) + ["".join(r.choice(list(" \n\n  ab'sté1.,!-_\t᠎<|")) for _ in range(r.randint(0, 20))) for _ in range(300)] + ["<|endoftext|> x", "don't\nwe'll", "a  b", "\n\nx \n", "x" * 20_000]
    d = frame(spark, rows(texts) + ODD)
    path = common.new_path(spark, "test-tokens")
    tokens.write_tokens(d, path, TOKENIZER)
    got = sorted(tokens.read_tokens(spark, path).collect(), key=lambda x: x["start"])
    encoder = tokens.encoder_of(TOKENIZER)
    want = Counter((x["doc_id"], tuple(encoder.tokenizer.encode(x["text"] or "", add_special_tokens=False).ids) + (0,)) for x in d.collect())
    assert Counter((x["doc_id"], tuple(np.frombuffer(x["ids"], "<u2").tolist())) for x in got) == want
    at = 0
    for x in got:
        assert x["start"] == at and x["n_tokens"] == len(x["ids"]) // 2
        at += x["n_tokens"]
    ids = [x["doc_id"] for x in got if x["doc_id"] is not None]
    assert ids == sorted(ids)
    sums = {x["start"]: x["ids_crc32"] for x in tokens.read_checksums(spark, path).collect()}
    assert all(sums[x["start"]] == zlib.crc32(np.frombuffer(x["ids"], "<u2").astype("<u4").tobytes()) for x in got)
    empty = common.new_path(spark, "test-tokens")
    tokens.write_tokens(d.limit(0), empty, TOKENIZER)
    assert tokens.read_tokens(spark, empty).collect() == []


@pytest.mark.parametrize("steps", [[1], [1] * 600, [5, 0, 0, 900_000, 1], list(range(300))])
def test_elias_fano(steps):
    values = np.cumsum(steps)
    e = tokens.EliasFano.encode(values, int(values[-1]))
    assert e.decode().tolist() == values.tolist() == [e.select(i) for i in range(len(values))]
    with pytest.raises(IndexError):
        e.select(len(values))
    n, u = len(values), max(1, int(values[-1]))
    assert 8 * (len(e.low) + len(e.high)) <= n * (3 + max(0, int(np.log2(max(1, u / n))))) + 32


LANGS = {"en": ["the", "and", "with", "thing", "other"], "de": ["und", "der", "schön", "nicht", "heit"], "fr": ["été", "dans", "pour", "leçon", "eaux"]}


def language_rows(seed, n):
    r = random.Random(seed)
    return [(i, " ".join(r.choice(LANGS[x]) + r.choice(LANGS[x]) * r.randint(0, 1) for _ in range(20)), x, f"s{i % 5}", 1, "c", "c") for i in range(n) for x in [r.choice(sorted(LANGS))]]


def test_language(spark):
    d = frame(spark, language_rows(9, 400) + ODD)
    model = langid.fit(d.where(common.crc_mod("doc_id", 4) != 2))
    got = {x["doc_id"]: x for x in langid.predict(d, model).collect()}
    for x in d.where("lang is not null and doc_id < 900").collect():
        assert got[x["doc_id"]]["lang_pred"] == x["lang"] and 0.5 < got[x["doc_id"]]["score"] <= 1
    assert {got[i]["lang_pred"] for i in (900, 901, 902)} == {"und"}
    assert model.predict("12 34 !!")[0] == "und" and model.predict("schönheit")[0] == "de"
    kept = {x["doc_id"] for x in langid.keep_known(d, model).collect()}
    assert kept >= set(range(400)) and not kept & {900, 901, 902}
    assert langid.fit(d.limit(0)).predict("the thing") == ("und", 0.0)


def test_toxicity(spark):
    r = random.Random(10)
    texts = prose(11, 600, 80)
    toxic = [i % 4 == 0 for i in range(600)]
    texts = [t + (" " + " ".join(r.sample(["idiot", "scum", "moron", "clown", "loser"], 3)) if bad else " fine words") for t, bad in zip(texts, toxic, strict=True)]
    d = frame(spark, rows(texts) + ODD)
    labels = spark.createDataFrame([(i, 1, int(b)) for i, b in enumerate(toxic)] + [(None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    part = common.crc_mod("doc_id", 5)
    got = {x["doc_id"]: x for x in toxicity.score(d, labels.where(part != 0)).collect()}
    assert len(got) == 606 - 1 and all(0 <= x["score"] <= 1 for x in got.values())
    right = [(got[i]["score"] >= 0.5) == toxic[i] for i in range(600)]
    assert sum(right) >= 594 and got[900]["score"] < 0.5 and got[4]["evidence"] is not None
    assert {x["score"] for x in toxicity.score(d.limit(3), labels.limit(0)).collect()} == {0.0}
    assert {x["score"] for x in toxicity.score(d.limit(3), labels.where("toxic = 1").limit(3)).collect()} == {1.0}
    assert toxicity.score(d.limit(0), labels).collect() == []


def test_terms_read_by_token(spark):
    r = random.Random(20)
    texts = [" ".join("".join(r.choice("abÄß.-_1'\u0130\u03a3é") for _ in range(r.randint(1, 9))) for _ in range(30)) for _ in range(50)] + ["word " * 300_000, "", None]
    number = {w: i for i, w in enumerate(sorted({w for t in texts for w in toxicity.terms(t)}))}
    reader = toxicity.Reader(number)
    for t in texts:
        want = sorted((number[w], n) for w, n in toxicity.terms(t).items())
        assert list(zip(*reader.counted(t), strict=True)) == want


def test_examples_drop_only_whole_copies(spark):
    shared = "one shared passage of words"
    texts = [f"{shared} and then {w} text" for w in ("alpha", "beta", "gamma")] + [f"  {shared.upper()} and then\nalpha TEXT"] + [f"{shared} and then alpha text"]
    labels = spark.createDataFrame([(0, 0), (1, 1), (2, 0), (3, 0), (4, 1)], "doc_id long, toxic int")
    assert {(x["doc_id"], x["toxic"]) for x in toxicity.examples(frame(spark, rows(texts)), labels).collect()} == {(0, 0), (1, 1), (2, 0), (4, 1)}


def test_neighbours_are_exact():
    r = random.Random(12)
    # terms 0 to 9 are frequent and have rows, the others postings
    some = lambda least: sorted({*r.sample(range(10), r.randint(1, 6)), *r.sample(range(10, 300), r.randint(least, 5))})
    weight = np.array([0.3] * 10 + [r.uniform(1, 3) for _ in range(290)])
    chosen = [some(0) for _ in range(700)]
    vectors = [toxicity.unit(weight, a, [r.randint(1, 4) for _ in a]) for a in chosen]
    index = toxicity.Index(weight, list(range(700)), [i % 2 for i in range(700)], vectors)
    assert 0 < len(index.rows) < 300 and len(index.at) > 0
    for _ in range(200):
        q = index.vector(a := some(1), [1] * len(a))
        dense = np.zeros(300)
        dense[q[0]] = q[1]
        every = sorted(((-round(float(sum(dense[t] * w for t, w in zip(*v, strict=True))), 9), i) for i, v in enumerate(vectors)))
        want = [(-s, i) for s, i in every if s < 0][: toxicity.NEIGHBOURS]
        assert [(s, i) for s, i, _ in index.neighbours(*q)] == want


def plain_targets(sizes, weights=(3.0, 1.0, 2.0)):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    target, left, open_ = {}, 1.5 * sum(sizes.values()), set(names)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        if not full:
            return target | {s: level * weight[s] for s in open_}
        for s in full:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= full
    return target


def test_mix(spark):
    r = random.Random(13)
    texts = prose(14, 900, 120)
    data = [(i, t, "en", None if i % 11 == 0 else "big" if i % 3 == 0 else f"s{i % 7}", 1, "c", "c") for i, t in enumerate(texts)] + ODD
    r.shuffle(data)
    d = frame(spark, data)
    got = mixing.mix(d).collect()
    again = mixing.mix(d.repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == len(data)
    sizes = Counter()
    for i, t, _, s, *_ in data:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    target, taken = plain_targets(sizes), Counter()
    for x in got:
        assert x["source_size"] == sizes[x["source"]] and x["target"] == pytest.approx(target[x["source"]]) and 0 <= x["taken"] <= 2 * x["size"]
        taken[x["source"]] += x["taken"]
    assert all(abs(taken[s] - target[s]) <= 0.5 for s in sizes)
    assert mixing.mix(d.limit(0)).collect() == []
    copies = Counter(x["doc_id"] for x in mixing.apply_mix(d).collect())
    assert set(copies.values()) <= {1, 2} and mixing.apply_mix(d).columns == d.columns


def test_slots_follow_targets(spark):
    t = spark.createDataFrame([(0, 6000.0), (1, 3000.0), (2, 1001.0), (3, 4.0), (4, 0.0)] + [(5 + i, 8.0) for i in range(40)], "sid long, target double")
    ranks, slots = {}, []
    for x in mixing.schedule(t, 10).collect():
        ranks.setdefault(x["sid"], []).append(x["rank"])
        slots.append(x["slot"])
    assert sorted(slots) == list(range(len(slots)))
    assert all(sorted(v) == list(range(len(v))) for v in ranks.values())
    assert {k: len(v) for k, v in ranks.items()} == {0: 600, 1: 300, 2: 101, 3: 1} | {5 + i: 1 for i in range(40)}


def discrepancy(slots, sizes):
    """The furthest that any source's words are from its share of a prefix of the mix, in words."""
    whole, seen, total, worst = sum(sizes.values()), Counter(), 0, 0.0
    for source, n in slots:
        seen[source] += n
        total += n
        worst = max(worst, *(abs(seen[s] - total * sizes[s] / whole) for s in sizes))
    return worst


def test_every_prefix_of_the_mix_is_near_the_shares(spark, monkeypatch):
    """The order of the mix comes from the schedule: every beginning of it has each source near its share, which one source after the other has not."""
    r = random.Random(31)
    data = [(i, " ".join("w" for _ in range(r.randint(1, 90))), "en", r.choice(["a", "a", "a", "b", "b", "c"]), 1, "c", "c") for i in range(700)]
    d = frame(spark, data)

    def laid():
        rows = mixing.mix_slots(d).collect()
        words, source = Counter(), {}
        for x in rows:
            words[x["slot"]] += x["words"]
            assert source.setdefault(x["slot"], x["source"]) == x["source"]
        taken = Counter()
        for s, n in words.items():
            taken[source[s]] += n
        return [(source[s], words[s]) for s in sorted(words)], taken, rows

    slots, taken, rows = laid()
    got = {x["doc_id"]: x for x in mixing.mix(d).collect()}
    of = {}
    for x in rows:
        of.setdefault(x["doc_id"], []).append(x)
    assert all(sum(y["words"] for y in of.get(i, [])) == x["taken"] and min((y["slot"] for y in of.get(i, [])), default=None) == x["first_slot"] for i, x in got.items())
    block = mixing.block_words(sum(x["size"] for x in got.values()))
    good = discrepancy(slots, taken)
    assert good <= 8 * block
    ordered = mixing.apply_mix(d).select("doc_id").collect()
    first = {}
    for place, x in enumerate(ordered):
        first.setdefault(x["doc_id"], place)
    by_slot = sorted((x["first_slot"], i) for i, x in got.items() if i in first)
    assert [i for _, i in by_slot] == sorted(first, key=lambda i: (got[i]["first_slot"], first[i]))

    def one_after_the_other(targets, block):
        few = mixing.owned(targets, block).where("slots > 0").orderBy("sid").collect()
        rows, at = [], 0
        for x in few:
            rows += [(at + k, x["sid"], k) for k in range(x["slots"])]
            at += x["slots"]
        return spark.createDataFrame(rows, "slot long, sid long, rank long")

    monkeypatch.setattr(mixing, "schedule", one_after_the_other)
    other, taken, _ = laid()
    assert other != slots and discrepancy(other, taken) > 20 * good


def test_tiny_sources_beside_a_huge_one(spark):
    data = [(i, "w " * 2000, "en", "huge", 1, "c", "c") for i in range(60)] + [(1000 + i, "one two three four five six seven eight", "en", f"t{i}", 1, "c", "c") for i in range(9)]
    taken, target = Counter(), {}
    for x in mixing.mix(frame(spark, data)).collect():
        taken[x["source"]] += x["taken"]
        target[x["source"]] = x["target"]
    assert all(abs(taken[s] - target[s]) <= 0.5 for s in target) and taken["t0"] > 0


def test_leaks(spark):
    items = prose(15, 30, 60)
    items = [t for t in items if len(t.split()) >= 12][:15]
    bench = spark.createDataFrame([*enumerate(items), (99, None), (98, ""), (None, items[0])], "item_id long, text string")
    r = random.Random(16)
    clean = prose(17, 80)

    def changed(t, share):
        w = t.split()
        for i in r.sample(range(len(w)), int(share * len(w))):
            w[i] = "zz"
        return " ".join(w)

    exact = [f"{c} {t.upper()}, {c}" for c, t in zip(clean, items, strict=False)]
    near = [f"{c} {changed(t, 0.1)} {c}" for c, t in zip(clean, items, strict=False)]
    d = frame(spark, rows(clean + exact + near) + ODD)
    got = {x["doc_id"]: x["contaminated"] for x in decontam.contamination(d, bench).collect()}
    assert not any(got[i] for i in range(80)) and all(got[80 + i] for i in range(len(items)))
    assert sum(got[80 + len(items) + i] for i in range(len(items))) >= 0.8 * len(items)
    blocks = {x["doc_id"] for x in decontam.hits(d, bench, broadcast_rows=50).collect()}
    assert blocks == {x["doc_id"] for x in decontam.hits(d, bench).collect()}
    assert decontam.decontaminate(d, bench).count() == d.count() - sum(got.values())
    assert decontam.contamination(d, bench.limit(0)).where("contaminated").count() == 0
    assert decontam.contamination(d.limit(0), bench).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    item = "one small passage of the benchmark that has enough words to be found again"
    data = language_rows(18, 200) + [(300, f"the other thing {item} and more", "en", "s1", 1, "c", "c"), *ODD]
    data += [(i + 400, *x[1:]) for i, x in enumerate(data[:30])]
    frame(spark, data).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontamination", "mixing", "token_files"]
    docs = common.table(spark, str(tmp_path), "documents")
    known = common.cut(corpus_pipeline.identify_language(spark, docs, str(tmp_path)))
    assert known.columns == docs.columns and not {900, 901, 902} & {x["doc_id"] for x in known.select("doc_id").collect()}
    single = common.cut(corpus_pipeline.drop_near_copies(spark, known, str(tmp_path)))
    assert not {x["doc_id"] for x in single.select("doc_id").collect()} & set(range(400, 430))
    clean = common.cut(corpus_pipeline.drop_leaks(spark, single, str(tmp_path)))
    assert {x["doc_id"] for x in single.collect()} - {x["doc_id"] for x in clean.collect()} == {300}
    out = corpus_pipeline.run(spark, str(tmp_path))
    mixed = corpus_pipeline.mix_sources(spark, clean, str(tmp_path))
    assert out.count() == mixed.count() and out.agg(F.sum("n_tokens")).first()[0] > 0
