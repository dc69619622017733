"""Line dedup against a plain version over lists of lines that shares no code with it."""

import random

from quire.llm import lines

BLANK = " \t\n\r\x0b\x0c"


def longest_rising(xs):
    """A longest strictly rising subsequence; of equals the one that ends lowest, step by step."""
    tails = []  # tails[n]: a rising sequence of n + 1 numbers that ends as low as possible
    for x in xs:
        n = next((n for n, t in enumerate(tails) if t[-1] >= x), len(tails))
        tails[n : n + 1] = [(tails[n - 1] if n else []) + [x]]
    return tails[-1] if tails else []


def aligned(a, b):
    """{place in b: place in a} by patience diff, from its definition."""
    out = {}
    while a and b and a[0][1] == b[0][1]:
        out[b[0][0]] = a[0][0]
        a, b = a[1:], b[1:]
    while a and b and a[-1][1] == b[-1][1]:
        out[b[-1][0]] = a[-1][0]
        a, b = a[:-1], b[:-1]
    if not a or not b:
        return out
    sa, sb = [x for _, x in a], [x for _, x in b]
    once = [x for x in sa if sa.count(x) == 1 and sb.count(x) == 1]
    if not once:
        return out
    chosen = longest_rising([sb.index(x) for x in once])
    i = j = 0
    for q in [*chosen, None]:
        p = len(a) if q is None else sa.index(sb[q])
        out |= aligned(a[i:p], b[j : len(b) if q is None else q])
        if q is not None:
            out[b[q][0]] = a[p][0]
            i, j = p + 1, q + 1
    return out


def brute(rows, min_words=5):
    """{doc_id: kept text} of rows with distinct ids: every document aligned with every earlier one."""
    cut = {i: (t or "").split("\n") for i, t in rows}
    key = {i: [x.strip(BLANK) for x in ls] for i, ls in cut.items()}
    sets = {i: set(ls) - {""} for i, ls in key.items()}
    holders = {}
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    out = {}
    for i, ls in cut.items():
        gone = set()
        # a line that one document alone holds matches nothing; runs of them are one
        for r in sorted({r for x in sets[i] for r in holders[x] if r < i}):
            other, last = [], None
            for x in key[r]:
                own = bool(x) and len(holders[x]) == 1
                if not (own and last):
                    other.append(None if own else x)
                last = own
            pairs = aligned(list(enumerate(other)), list(enumerate(x if not x or len(holders[x]) > 1 else (i, n) for n, x in enumerate(key[i]))))
            n = 0
            while n < len(ls):
                end = n
                while end in pairs and (end == n or pairs[end] == pairs[end - 1] + 1):
                    end += 1
                if sum(len(x.split()) for x in ls[n:end]) >= min_words:
                    gone.update(range(n, end))
                n = max(end, n + 1)
        out[i] = "\n".join(x for n, x in enumerate(ls) if n not in gone)
    return out


def deduped(spark, rows):
    return {r.doc_id: r.kept for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


def test_patience_aligns_equal_lines_in_order():
    rnd = random.Random(3)
    for _ in range(300):
        a = [rnd.randrange(12) for _ in range(rnd.randrange(30))]
        b = list(a)
        for _ in range(rnd.randrange(5)):
            b[(at := rnd.randrange(len(b) + 1)) : at + rnd.randrange(3)] = [rnd.randrange(40)] * rnd.randrange(3)
        got = lines.patience(a, b)
        assert all(a[i] == b[j] for i, j in got)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(got, got[1:], strict=False))
        assert lines.patience(a, a) == [(i, i) for i in range(len(a))]
        assert len(got) == len(aligned(list(enumerate(a)), list(enumerate(b))))
    assert lines.patience([1, 2, 3, 9, 4], [7, 1, 2, 3, 4]) == [(0, 1), (1, 2), (2, 3), (4, 4)]


def test_equals_alignment_of_the_tables_documents(spark, data):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    base = ["one two three four five", "six seven eight nine ten", "a b", "", "eleven twelve thirteen fourteen"]
    extra = [(5000, "\n".join(base)), (5001, "\n".join(base)), (5002, "\n".join([base[0], "new line here", *base[1:]])), (5003, None), (5004, ""), (5005, "\n\n"), (5006, "a b"), (5007, " a b \nlast"), (5008, "x " * 40000 + "\n" + base[0])]
    rows = docs + extra
    got = deduped(spark, rows)
    assert got == brute(rows)
    assert got[5001] == "" and got[5000] == "\n".join(base)


def test_equals_alignment_with_every_earlier_document(spark):
    rnd = random.Random(11)
    pool = [" ".join(f"w{k}_{j}" for j in range(rnd.choice((0, 0, 1, 2, 3, 5, 8)))) for k in range(25)]
    rows = []
    for i in range(400):
        ls = [rnd.choice(pool) if rnd.random() < 0.75 else f"own{i}_{n} a b" for n in range(rnd.randrange(1, 12))]
        if rows and rnd.random() < 0.5:  # part of an earlier document
            old = rnd.choice(rows)[1].split("\n")
            ls[(at := rnd.randrange(len(ls))) : at] = old[(a := rnd.randrange(len(old))) : a + 4]
        rows.append((i, "\n".join(ls)))
    rnd.shuffle(rows)
    assert deduped(spark, rows) == brute(rows)


def test_further_holders_of_a_line(spark):
    a, b = "one two three four five six", "six seven eight nine ten eleven twelve"
    rows = [(1, f"{a}\nx\n{b}"), (2, f"{b}\ny\n{b} z\n{a}"), (3, f"{b}\nu\nv\n{a}"), (4, "p q\nr s t"), (5, "p q\nalone\nr s t"), (6, "r s t\nmore\np q\nr s t")]
    got = deduped(spark, rows)
    assert got == brute(rows) and got[3] == "u\nv" and got[6] == "r s t\nmore"


def test_lines_with_different_first_holders(spark):
    short = [f"line w{k}" for k in range(20)]
    rows = [*((k, x) for k, x in enumerate(short)), (100, "\n".join(["head of one", *short])), (101, "\n".join([*short, "end of the other"]))]
    got = deduped(spark, rows)
    assert got == brute(rows) and got[101] == "end of the other" and got[100] == rows[20][1]


def test_a_document_with_many_partners(spark):
    said = [f"sentence {k} of five words" for k in range(60)]
    rows = [*((k, f"{x}\nown {k}") for k, x in enumerate(said)), (99, "\n".join(["first", *(f"{x}\nbetween {k}" for k, x in enumerate(said))]))]
    got = deduped(spark, rows)
    assert got[99] == "\n".join(["first", *(f"between {k}" for k in range(60))])


def test_a_line_of_all_documents(spark):
    rows = [(k, f"the same five words here\nnumber {k}") for k in range(300)]
    got = deduped(spark, rows)
    assert got[0] == rows[0][1] and all(got[k] == f"number {k}" for k in range(1, 300))


def test_edges(spark):
    schema = "doc_id long, text string, key string, line int"
    assert lines.dedup_lines(spark.createDataFrame([], schema)).count() == 0
    same = "one two three four five six\nseven eight nine ten eleven"
    rows = [(None, same, "k", 1), (None, same, "k", 1), (1, same, "k", 1), (1, same, "k", 1), (2, same, None, None)]
    got = sorted((r.doc_id or 0, r.n_removed) for r in lines.dedup_lines(spark.createDataFrame(rows, schema)).collect())
    assert got == [(0, 0), (0, 0), (1, 0), (1, 0), (2, 2)]
