"""Quality trees, SimHash, near copies, decontamination and the pipeline."""

import random
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from quire.llm import decontaminate, lines, nearcopies, quality, queries, simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, fp string, pos string, n_chars long")


def test_statistics_equal_plain(spark, data):
    texts = [r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()] + [None, "", " \n ", "a a a a", "x\nx\n x\n\nx", "é" * 3000 + " #$", "1 2 3 1 2 3 4"]
    counts, x = quality.statistics(pa.array(texts))
    assert x.shape == (len(texts), len(quality.FEATURES)) and np.isfinite(x).all()
    for k, t in enumerate(texts):
        t = t or ""
        w = WORD.findall(t)
        tri = Counter(zip(w, w[1:], w[2:], strict=False))
        cover = {q for p in range(len(w) - 2) if tri[w[p], w[p + 1], w[p + 2]] > 1 for q in range(p, p + 3)}
        seen, dup = set(), 0
        for line in t.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        assert tuple(int(counts[c][k]) for c in quality.COUNTS) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(cover))


def test_trees_are_monotonic_and_flattened_right():
    rnd = np.random.default_rng(2)
    x = rnd.random((800, 3))
    good = x[:, 0] + 0.3 * np.sin(9 * x[:, 1]) + 0.2 * rnd.random(800) < 0.6
    trees = quality.train(x, good, signs=(-1, 0, 0), trees=25)
    assert ((trees.score(x) >= 0) == good).mean() > 0.9
    walk = lambda row: trees.start + sum(_leaf(trees, r, row) for r in trees.roots)
    assert trees.score(x[:40]) == pytest.approx([walk(r) for r in x[:40]])
    for row in x[:60]:
        up = np.tile(row, (50, 1))
        up[:, 0] = np.linspace(0, 1, 50)
        assert (np.diff(trees.score(up)) <= 1e-12).all()
    assert quality.train(x, np.ones(800, bool)) is None and quality.train(x[:0], np.zeros(0, bool)) is None


def _leaf(t, node, row):
    while t.left[node] != node:
        node = t.left[node] if row[t.feature[node]] <= t.cut[node] else t.right[node]
    return t.value[node]


def test_quality_query_and_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    trees = quality.train_on(docs, labels.where("doc_id % 3 <> 0"))
    held = quality.judged(docs, trees).join(labels.where("doc_id % 3 = 0"), "doc_id").where("NOT base_failed").collect()
    assert sum(r.kept == (r.quality == 1) for r in held) >= 0.95 * len(held) > 50
    assert quality.judged(docs, None).where("kept = base_failed").count() == 0
    assert quality.judged(frame(spark, []), trees).count() == 0
    odd = {r.doc_id: r for r in quality.judged(frame(spark, [(1, None), (None, "a b")]), trees).collect()}
    assert odd[1].base_failed and odd[1].n_words == 0 and odd[None].n_words == 2


def plain_simhash(text, k):
    w = re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    sh = [" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


@pytest.mark.parametrize("bucket", [32, 2])
def test_simhash_components_equal_all_pairs(spark, data, bucket):
    rnd = random.Random(4)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").limit(120).collect()]
    long = " ".join(f"w{rnd.randrange(5000)}" for _ in range(600)).split()
    for n in range(90):  # a crowd of near copies
        w = list(long)
        for _ in range(rnd.randrange(4)):
            w[rnd.randrange(600)] = f"v{rnd.randrange(99)}"
        rows.append((5000 + n, " ".join(w)))
    rows += [(8000, None), (8001, ""), (8002, " "), (8003, "Two words"), (8004, "two WORDS"), (5001, "same id"), (None, rows[0][1])]
    fps = [plain_simhash(t, 3) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= 2:
            parent[find(j)] = find(i)
    least: dict = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    want = sorted((str(doc), fps[i], least.get(find(i))) for i, (doc, _) in enumerate(rows))
    got = simhash.near_duplicates(frame(spark, rows), 3, 2, bucket).collect()
    assert sorted((str(r.doc_id), r.fp % (1 << 64), r.component_id) for r in got) == want
    assert simhash.near_duplicates(frame(spark, []), 3, 2).count() == 0


def test_thresholds_keep_the_pigeonhole():
    rnd = np.random.default_rng(1)
    sample = rnd.integers(-(1 << 62), 1 << 62, 500)
    for n in (1000, 10**10):
        plan = simhash.choose(sample, n, 2)
        used = sum(t for _, t in plan)
        assert used + len(plan) >= 3  # any two within 2 bits meet in a part
        assert sum(len(p) for p, _ in plan) <= 64


def test_near_copies_keep_one_of_each(spark, data):
    rnd = random.Random(6)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").limit(80).collect()]
    for g in range(20):
        w = [f"g{g}w{rnd.randrange(400)}" for _ in range(300)]
        for n in range(6):
            v = list(w)
            for _ in range(2):
                v[rnd.randrange(300)] = "edit"
            rows.append((9000 + 10 * g + n, " ".join(v)))
    kept = {r.doc_id for r in nearcopies.one_of_each(frame(spark, rows)).collect()}
    for g in range(20):
        assert {i for i in kept if i // 10 == 900 + g} == {9000 + 10 * g}
    shingles = {i: {tuple(w[p : p + 5]) for p in range(max(1, len(w) - 4))} for i, t in rows if (w := (t or "").lower().split()) or True}
    for i, t in rows:  # what goes has a partner that is alike
        if i not in kept and i < 9000:
            assert any(j != i and len(shingles[i] & shingles[j]) >= 0.8 * len(shingles[i] | shingles[j]) for j, _ in rows)
    assert nearcopies.one_of_each(frame(spark, [])).count() == 0
    odd = nearcopies.one_of_each(frame(spark, [(None, "a b c"), (None, "a b c"), (3, None), (4, "")])).collect()
    assert sorted((r.doc_id or 0) for r in odd) == [0, 3]


ITEM = "Yesterday Tom bought 12 apples at the market on Monday and gave 5 apples to Anna before he walked 3 km home with Tom again"


@pytest.mark.parametrize("anchors", [20_000, 0])
def test_leaks_of_templates(spark, anchors, monkeypatch):
    monkeypatch.setattr(decontaminate, "ANCHORS", anchors)
    swap = ITEM.replace("Tom", "Bob").replace("12", "40").replace("Anna", "Eve").replace("km", "miles")
    rows = [
        (1, "intro words here. " + ITEM + ". And more text"), (2, "x " + swap + " y"), (3, "x " + swap.replace("Bob again", "Max again") + " y"), (4, ITEM.lower()), (5, "Something else about apples at the market on a day"),
        (6, None), (7, ""), (None, ITEM), (8, "* * *\n" + ITEM.replace(" ", "\n\t")),
    ]
    bench = spark.createDataFrame([(10, ITEM, 1), (11, "too short item", 1), (12, None, 1)], "item_id long, text string, pos int")
    got = {r.doc_id: r for r in decontaminate.leaks(frame(spark, rows), bench).collect()}
    assert set(got) >= {1, 2, None, 8} and not set(got) & {3, 5, 6, 7} and {r.item_id for r in got.values()} == {10}
    assert got[2].changed and not got[1].changed
    assert {r.doc_id for r in decontaminate.clean(frame(spark, rows), bench).collect()} == {i for i, _ in rows} - set(got)
    assert decontaminate.leaks(frame(spark, []), bench).count() == 0 and decontaminate.leaks(frame(spark, rows), bench.limit(0)).count() == 0


def test_stages_on_odd_tables(spark, data):
    import corpus_pipeline

    same = "one two three four five six\nseven eight nine ten eleven"
    schema = "doc_id long, text string, lang string, source string, n_chars long, key string, gone int, kept string, c0 string, q_row string, pos string"
    rows = [(1, same, None, None, None, "k", 1, "x", "c", "r", "p"), (1, same, None, None, None, "k", 1, "x", "c", "r", "p"), (2, same + "\nnew words", "en", "s", 5, None, None, None, None, None, None), (None, None, None, None, None, "k", 1, "x", "c", "r", "p"), (3, "", None, None, 0, "k", 1, "x", "c", "r", "p"), (4, "w " * 90_000, None, None, 1, "k", 1, "x", "c", "r", "p")]
    for df in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, df, data)
            assert out.columns == df.columns and out.count() <= len(rows)
        assert corpus_pipeline.STAGES[-1][1](spark, df, data).count() == df.count()
    cut = {r.doc_id: r for r in corpus_pipeline.line_dedup(spark, spark.createDataFrame(rows, schema), data).collect()}
    assert (cut[2].text, cut[2].n_chars, cut[1].key, cut[1].text) == ("new words", 9, "k", same)


def test_pipeline_stages(spark, data):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "decontamination", "encoding"]
    docs = spark.read.parquet(f"{data}/documents.parquet").withColumnRenamed("lang", "lang").cache()
    kept = corpus_pipeline.quality_rules(spark, docs, data)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    cut = {r.doc_id: r for r in corpus_pipeline.line_dedup(spark, docs, data).collect()}
    plain = {r.doc_id: r.kept for r in lines.dedup_lines(docs).collect()}
    for i, text in plain.items():
        assert (cut[i].text == text and cut[i].n_chars == len(text)) if i in cut else not text.strip()
    out = corpus_pipeline.run(spark, data).collect()
    ids = {r.doc_id for r in out}
    assert len(ids) == len(out) and ids <= {r.doc_id for r in kept.collect()}
    leaking = {r.doc_id for r in queries.op7_template_leaks(spark, data).collect()}
    assert len(leaking & ids) < len(leaking)


@pytest.mark.parametrize("anchors", [20_000, 0])
def test_leaks_in_any_case(spark, anchors, monkeypatch):
    monkeypatch.setattr(decontaminate, "ANCHORS", anchors)
    clash = ITEM.replace("Tom bought", "Max bought").replace("Tom again", "Bob again")
    rows = [(1, "X Y " + ITEM.upper() + " END"), (2, ITEM.title()), (3, "Some other TEXT ABOUT APPLES AT THE MARKET"), (4, clash)]
    got = {r.doc_id for r in decontaminate.leaks(frame(spark, rows), spark.createDataFrame([(10, ITEM)], "item_id long, text string")).collect()}
    assert got == {1, 2, 4}


SLOTS = "Tom paid 12 dollars and 5 cents to Anna Bell in May 2010 for 3 kg of Rome Beauty apples in Oslo"
AGAIN = "Kim paid 7 dollars and 9 cents to Olga Berg in June 1999 for 8 kg of Granny Smith apples in Lima"


def test_leaks_of_short_items_and_items_rich_in_slots(spark):
    bench = [(1, SLOTS), (2, "Solve 2x + 3 = 11 for x"), (3, "short one"), (4, None), (5, "12 13 14 15 16 17 18 19 20 21"), (6, "who wrote the old book")]
    rows = [
        (1, SLOTS), (2, "Well. " + AGAIN + " and so on"), (3, "see 12 13 14 15 16 17 18 19 20 21 end"), (4, "22 23 24 25 26 27 28 29 30 31"), (5, "short one"), (6, "Solve 2x + 3 = 11 for x"),
        (7, "x " + SLOTS.upper()), (8, AGAIN.replace("Lima", "Smith")), (9, "So who wrote the old book then"), (10, "who wrote the new book"), (11, SLOTS.replace("and 5 cents", "")),
    ]
    want = {(1, 1), (2, 1), (3, 5), (6, 2), (7, 1), (9, 6), (11, 1)}  # 8 gives two names of the item one name
    for anchors in (20_000, 0):
        found = decontaminate.leaks(frame(spark, rows), spark.createDataFrame(bench, "item_id long, text string"), anchors)
        assert {(r.doc_id, r.item_id) for r in found.collect()} == want


def test_reparameterised_items_are_found(spark):
    """Of items made up at random, asked again with other values; anchors change nothing."""
    rnd, n, units = random.Random(12), iter(range(1, 10**6)), ["km", "kg", "days", "dollars"]
    common = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(200)]
    name = lambda: "N" + "".join(chr(97 + int(d)) for d in str(next(n)))
    rows, bench = [], []
    for i in range(150):
        item, again = [], []
        for kind in (rnd.choice("wwwwwwnnNu") for _ in range(rnd.randrange(9, 40))):
            word, k = rnd.choice(common), rnd.randrange(4)
            a, b = {"w": (word, word), "n": (str(next(n)), str(next(n))), "N": (name(), name()), "u": (units[k], units[k - 1])}[kind]
            item.append(a)
            again.append(b)
        bench.append((i, " ".join(item)))
        rows.append((i, "before it some words stand, and then " + " ".join(again) + " and some behind it"))
    rows += [(1000 + i, " ".join(rnd.choice(common) for _ in range(60))) for i in range(100)]
    both = [{(r.doc_id, r.item_id, r.covered) for r in decontaminate.leaks(frame(spark, rows), spark.createDataFrame(bench, "item_id long, text string"), a).collect()} for a in (20_000, 0)]
    hit = {i for i, j, _ in both[0] if i == j}
    assert both[0] == both[1] and len(hit) >= 0.9 * len(bench) and not any(i >= 1000 for i, _, _ in both[0])


def test_pairs_at_the_bound_become_candidates():
    rnd, pairs = random.Random(5), []
    while len(pairs) < 200:
        a = [f"w{rnd.randrange(3000)}" for _ in range(300)]
        b = list(a)
        for _ in range(rnd.randrange(5, 9)):
            b[rnd.randrange(300)] = f"e{rnd.randrange(10**6)}"
        x, y = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a, b))
        if 0.8 <= len(x & y) / len(x | y) < 0.82:
            pairs.append([nearcopies.fingerprints_of(" ".join(w).encode()) for w in (a, b)])
    masks = nearcopies._plan(np.array([f[0] for p in pairs for f in p], np.int64))
    found = sum(any((x & m) == (y & m) for x, y in zip(*p, strict=True) for m in masks) for p in pairs)
    assert found >= 0.98 * len(pairs)


@pytest.mark.parametrize("most", [1, 3, 16])
def test_runs_of_a_stream(most):
    rnd = random.Random(most)
    value = sorted(rnd.choice(range(12)) for _ in range(400)) + [20] * 90 + [21]
    rows = list(zip(value, range(len(value)), strict=True))
    cuts = sorted({0, len(rows), *(rnd.randrange(len(rows)) for _ in range(40))})
    batches = [pa.RecordBatch.from_pydict({"v": [v for v, _ in rows[a:b]], "k": [k for _, k in rows[a:b]]}) for a, b in zip(cuts, cuts[1:], strict=False)]
    count = Counter(value)
    got, pairs = [], set()
    for (v, k), n in nearcopies._sorted_runs(iter(batches), most):
        got += list(zip(v.tolist(), k.tolist(), n.tolist(), strict=True))
        for i, j in nearcopies._pairs(v, n, most):
            pairs |= set(zip(k[i].tolist(), k[j].tolist(), strict=True))
    assert got == [(v, k, min(count[v], most + 1)) for v, k in rows]
    assert pairs == {(a, b) for (v, a), (w, b) in combinations(rows, 2) if v == w and count[v] <= most}


def shingle_sets(rows):
    return {i: {tuple(w[p : p + 5]) for p in range(max(1, len(w) - 4))} for i, t in rows if (w := (t or "").lower().split()) or True}


def all_groups(rows, similarity=0.8):
    """{doc_id: smallest doc_id of its group}, by all pairs."""
    sets, parent = shingle_sets(rows), {i: i for i, _ in rows}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for (i, x), (j, y) in combinations(sorted(sets.items()), 2):
        if min(len(x), len(y)) >= similarity * max(len(x), len(y)) and len(x & y) >= similarity * len(x | y):
            a, b = sorted((find(i), find(j)))
            parent[b] = a
    return {i: find(i) for i in parent}


def edited(rnd, words, n, name):
    out = list(words)
    for at in rnd.sample(range(len(words)), n):
        out[at] = f"{name}{rnd.randrange(10**9)}"
    return out


@pytest.mark.parametrize("bucket", [16, 2])
def test_groups_equal_all_pairs(spark, bucket):
    """Pairs at 0.80 to 0.95 alone, pairs in a crowd with common passages, and a family of copies of one text that are
    alike to it but hardly to each other."""
    rnd, rows = random.Random(8), []
    fresh = lambda n, name: [f"{name}{rnd.randrange(10**6)}" for _ in range(n)]
    for i in range(60):
        w = fresh(rnd.choice((40, 120, 400)), f"p{i}_")
        rows += [(len(rows), " ".join(w)), (len(rows) + 1, " ".join(edited(rnd, w, max(1, len(w) // rnd.randrange(46, 90)), "e")))]
    template = fresh(200, "t")
    for i in range(60):
        w = template + fresh(80, f"d{i}_")
        rows += [(len(rows), " ".join(w)), (len(rows) + 1, " ".join(w[:-14] + fresh(14, "f")))]
    base = fresh(300, "b")
    rows += [(len(rows) + n, " ".join(edited(rnd, base, 4 if n else 0, f"c{n}_"))) for n in range(80)]
    want = all_groups(rows)
    got = nearcopies.groups(frame(spark, rows), bucket=bucket).collect()
    ids = {r.key: r.doc_id for r in frame(spark, rows).selectExpr("doc_id", "xxhash64(doc_id, text) AS key").collect()}
    found = {ids[r.key]: ids[r.keeper] for r in got}
    links = {i for i, root in want.items() if root != i}
    missed = {i for i in links if found[i] != want[i]}
    assert len(links) > 150 and len(missed) <= 0.02 * len(links)
    assert all(found[i] == i for i, root in want.items() if root == i)  # nothing that has no link goes


def test_documents_of_common_shingles_alone(spark, tmp_path):
    """Documents of the same passages in another order: all that two share is common, and few are alike to the centre."""
    rnd = random.Random(3)
    passages = [[f"w{k}_{i}" for i in range(40)] for k in range(24)]
    texts = []
    for _ in range(24):
        chosen = rnd.sample(range(24), 10)
        for _ in range(2):
            texts.append(" ".join(w for k in chosen for w in passages[k]))
            rnd.shuffle(chosen)
    sets = nearcopies._sets(spark.createDataFrame(list(enumerate(texts)), "key long, text string"), 5)
    crowd = spark.createDataFrame([(1, k) for k in range(len(texts))], "v long, key long")
    per = nearcopies.firsts(sets, str(tmp_path), 0.8, 8)
    edges = nearcopies.verified(nearcopies.rare_pairs(per, crowd, 8), sets, 0.8)
    roots = nearcopies.components(edges, str(tmp_path / "c"))
    late = nearcopies.verified(nearcopies.common_pairs(per, roots, 0.8, 8), sets, 0.8)
    words = [t.split() for t in texts]
    own = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in words]
    alike = {(a, b) for b in range(len(own)) for a in range(b) if len(own[a] & own[b]) >= 0.8 * len(own[a] | own[b])}
    star = {(r.a, r.b) for r in edges.collect()}
    assert len(alike) >= 24 and len(alike - star) > 8  # the centres alone lose these
    assert star | {(r.a, r.b) for r in late.collect()} == alike
