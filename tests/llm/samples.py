"""Small document tables with the awkward cases: nulls, empty, long, repeated, and clashing columns."""

from __future__ import annotations

import random

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega été naïve Straße Ωmega 日本語 emoji😀".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng: random.Random, n: int) -> str:
    """n words in lines of varied length."""
    return "".join(rng.choice(WORDS) + rng.choice([" ", " ", " ", " ", ". ", ", ", "\n", "  ", "\t"]) for _ in range(n))


def awkward(seed: int = 1) -> list[tuple]:
    """Rows (doc_id, text, lang, source, n_chars)."""
    rng = random.Random(seed)
    texts: list[str | None] = [None, "", " \n\t ", "one", "one two three four", "a b c d e", "A B C D E", prose(rng, 20_000), "x" * 30_000, "\n".join(["same line here"] * 30)]
    texts += [prose(rng, rng.randint(1, 200)) for _ in range(30)]
    base = prose(rng, 150)
    texts += [base] * 4
    for i in range(12):  # near copies
        words = base.split(" ")
        words[rng.randrange(len(words))] = f"changed{i}"
        texts.append(" ".join(words))
    rows = [(i * 3 + 5, t, rng.choice(["en", "de", None]), rng.choice(["hot", "hot", "web", None]), None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[12], rows[12], rows[-1]]  # repeated rows
    rows.append((None, "a row without an id", "en", "web", 19))
    rng.shuffle(rows)
    return rows


def frame(spark, rows: list[tuple], clash: dict[str, str] | None = None):
    """The rows as a table; clash: further columns by name and SQL."""
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for name, sql in (clash or {}).items():
        df = df.selectExpr("*", f"{sql} AS {name}")
    return df


def many_of_one_id(seed: int = 4) -> list[tuple]:
    """Rows of which a third has no id and a third has the same one."""
    rng = random.Random(seed)
    return [(rng.choice([None, 21, i]), prose(rng, rng.randint(0, 30)), "en", "web", 0) for i in range(150)]


def hashes(spark, rows: list[tuple]) -> dict:
    """The 64-bit hash of each text that Spark gives."""
    texts = sorted({r[1] for r in rows}, key=lambda t: (t is not None, t or ""))
    return {r.t: r.h for r in spark.createDataFrame([(t,) for t in texts], "t string").selectExpr("t", "xxhash64(t) as h").collect()}
