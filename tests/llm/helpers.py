"""Small tables with awkward rows, shared by the tests of this folder."""

import random

DOCS = "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG, score STRING, n_hit STRING, size STRING, part STRING"
WORDS = "the of and Thrion edly ES été straße 中文 42 shnd, ernt. a-b".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 400)) for _ in range(n))


def texts(seed=1):
    """Unlike texts, copies, near copies, shared passages, short ones, odd white space, null and empty."""
    rng = random.Random(seed)
    base = [prose(rng, rng.randint(20, 120)) for _ in range(25)]
    passage = prose(rng, 40)
    out = list(base)
    for t in base[:8]:
        w = t.split(" ")
        w[len(w) // 2] = "changed"
        out += [t, " ".join(w), t.upper()]
    out += [f"{prose(rng, 30)} {passage} {prose(rng, 30)}" for _ in range(6)]
    near = prose(rng, 200).split(" ")
    for i in range(14):
        w = list(near)
        w[i * 7] = f"x{i}"
        out.append(" ".join(w[: 200 - i]))
    out += [None, "", " \n\t ", "one", "one two three", "one  two\nthree", "x" * 5000, "a b " * 3000, "▁<s>é́", "no break"]
    return out


def documents(spark, rows=None, seed=1):
    """Rows of (doc_id, text) with clashing extra columns."""
    if rows is None:
        rows = list(enumerate(texts(seed)))
        random.Random(seed).shuffle(rows)
    full = [(i, t, "en", None if i is None else f"s{i % 4}" if i % 5 else None, len(t or ""), "x", "x", "x", "x") for i, t in rows]
    return spark.createDataFrame(full, DOCS).repartition(5)
