import random

from barfold.llm import line_dedup as ld


def _near(x, y):
    if x == y:
        return True
    a, b = x.split(), y.split()
    if min(len(a), len(b)) < 5 or abs(len(a) - len(b)) > 1:
        return False
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(p != q for p, q in zip(a, b, strict=True)) <= 1
    return any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def _brute(rows):
    """As the operator defines it: an earlier line counts even if it went itself."""
    seen, out = [], {}
    for key, text in sorted(rows):
        kept = []
        for line in text.split("\n"):
            bare = line.strip(" ")
            gone = bool(bare) and any(_near(bare, s) for s in seen)
            if bare:
                seen.append(bare)
            if not gone:
                kept.append(line)
        out[key] = "\n".join(kept)
    return out


def test_same_as_brute_force(spark):
    rnd = random.Random(5)
    base = [" ".join(rnd.choice("abcdefg") for _ in range(rnd.randint(1, 9))) for _ in range(60)]
    rows = []
    for key in range(60):
        lines = []
        for _ in range(rnd.randint(0, 6)):
            words = rnd.choice(base).split()
            for _ in range(rnd.randint(0, 2)):
                at = rnd.randrange(len(words) + 1)
                words[at : at + rnd.randint(0, 1)] = rnd.choice([[], ["x"], ["y"]])
            lines.append(" ".join(words))
        rows.append((key, "\n".join(lines)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in ld.dedup_lines(docs).collect()}
    assert got == _brute(rows)


def test_one_edit(spark):
    cases = [("a b c", "a b c"), ("a b c", "a x c"), ("a b c", "a c"), ("a c", "a b c"), ("a b", "b a"), ("", "a"),
             ("a a a", "a a"), ("a b c d", "b c d e"), ("x a b", "a b"), ("a b x", "a b")]
    df = spark.createDataFrame([(a.split(), b.split(), a, b) for a, b in cases], "x array<string>, y array<string>, a string, b string")
    got = {(r.a, r.b): r.ok for r in df.select("a", "b", ld.one_edit("x", "y").alias("ok")).collect()}
    assert [k for k, v in got.items() if not v] == [("a b", "b a"), ("a b c d", "b c d e")]


def test_rows_of_every_kind(spark):
    rows = [
        (1, "one two three four five\n\n\none two three four five", "k"), (2, None, "k"), (3, "", None),
        (4, "one two three four SIX\nshort\nshort", "k"), (4, "one two three four SIX\nshort\nshort", "k"),
        (None, "short", "k"), (5, " short ", "k"), (6, "w " * 3000 + "\n" + "w " * 3001, "k"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_lines string")
    got = {(r.doc_id, r.text): (r.n_lines, r.n_dropped) for r in ld.dedup_lines(docs).collect()}
    assert got == {
        (1, "one two three four five\n\n"): (4, 1), (2, None): (0, 0), (3, ""): (1, 0), (4, "short"): (3, 2),
        (None, "short"): (1, 0), (5, ""): (1, 1), (6, "w " * 3000): (2, 1),
    }
    assert ld.dedup_lines(docs.limit(0)).count() == 0
