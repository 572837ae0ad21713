"""Small corpora with nulls, empty and long texts, ties, repeated rows and copies, and a reader for them."""

import random
import re

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def corpus(seed: int = 1, families: int = 8, size: int = 6) -> list[tuple[int, str | None]]:
    """(doc_id, text): families of near and exact copies, shared passages and lines, odd rows."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeéßñ") for _ in range(rng.randint(1, 6))) for _ in range(400)]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, notice = line(70), "All rights reserved. " + line(6)
    texts: list[str | None] = [None, "", "   \n\t ", "one", "One", "ONE two", "É é", "a b c d", "x" * 5000, "ab " * 900, notice, notice]
    for _ in range(families):
        base = [line(rng.randint(8, 30)) for _ in range(rng.randint(1, 7))]
        texts.append("\n".join(base))
        for _ in range(rng.randint(0, size)):
            own = [x.split(" ") for x in base]
            for _ in range(rng.randint(0, 6)):
                row = rng.choice(own)
                row[rng.randrange(len(row))] = rng.choice(words).upper()
            texts.append("\n".join(" ".join(x) for x in own))
        texts.append("\n".join([line(12), passage, line(9), notice]))
        texts.append(texts[-3])
    rng.shuffle(texts)
    return list(enumerate(texts))


def frame(spark, rows, extra: bool = True):
    """rows as documents; extra columns have names that operators use themselves."""
    kind = "string" if any(isinstance(i, str) for i, _ in rows) else "long"
    df = spark.createDataFrame(rows, f"doc_id {kind}, text string")
    return df.selectExpr("*", "cast(hash(doc_id) % 3 as int) as n", "'z' as key", "0 as score", "doc_id as id") if extra else df


def spaced(text: str | None) -> list[str]:
    return [w for w in re.split("[ \t-\r]+", (text or "").translate(LOWER)) if w]


class Union:
    def __init__(self, items):
        self.up = {x: x for x in items}

    def root(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, x, y):
        a, b = self.root(x), self.root(y)
        self.up[max(a, b)] = min(a, b)
