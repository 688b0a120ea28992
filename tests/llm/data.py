"""Small tables that hold the odd cases, and plain versions of the operators."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def texts(seed: int, n: int, words: int = 120) -> list[str]:
    r = random.Random(seed)
    vocab = ["".join(r.choices("abcdeé", k=r.randint(1, 6))) for _ in range(300)]
    shared = [" ".join(r.choices(vocab, k=70)) for _ in range(3)]
    out = []
    for i in range(n):
        own = " ".join(r.choices(vocab, k=r.randint(0, words)))
        kind = r.random()
        if kind < 0.3:
            own = own[: len(own) // 2] + " " + r.choice(shared) + " " + own[len(own) // 2 :]
        elif kind < 0.5 and out:
            own = r.choice(out).replace("a", "a", 1)
            cut = own.split(" ")
            if cut and r.random() < 0.7:
                cut[r.randrange(len(cut))] = "edited"
            own = " ".join(cut)
        out.append(own)
    return out


def table(spark, seed: int = 1, n: int = 60, odd: bool = True):
    rows = [(i * 3, t, "en", f"s{i % 4}", len(t)) for i, t in enumerate(texts(seed, n))]
    if odd:
        rows += [(1000, None, None, None, None), (1001, "", "en", "s1", 0), (1002, " \t\n ", "en", None, 4), (1003, "one", "en", "s2", 3), (1004, "ab " * 700, "en", "s2", 2100), (1005, "ab " * 700, "en", "s2", 2100), (1006, "a" * 900, "en", "s0", 900), (None, rows[0][1], "en", "s0", 1), (0, rows[0][1], "en", "s0", 1)]
    random.Random(seed).shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA), rows
