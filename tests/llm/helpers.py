"""A small corpus with copies, near copies, shared passages, odd rows, and plain versions to compare with."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(seed: int = 7, n: int = 60) -> list[tuple]:
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("aeioußnrstlé", k=rng.randint(2, 8))) for _ in range(400)]

    def prose(k):
        return " ".join(rng.choices(vocabulary, k=k))

    line = "All rights reserved and no part of this may be copied without leave of the holder of the rights."
    passage = prose(70)
    texts = []
    for i in range(n):
        kind = i % 10
        if kind == 0 or len(texts) < 3:
            texts.append(prose(rng.randint(20, 200)))
        elif kind == 1:
            texts.append(rng.choice(texts))
        elif kind in (2, 3):
            words = rng.choice(texts).split(" ")
            for _ in range(max(1, len(words) // 60)):
                words[rng.randrange(len(words))] = "changed"
            texts.append(" ".join(words))
        elif kind == 4:
            texts.append(prose(30) + "\n" + passage + "\n" + prose(20))
        elif kind == 5:
            texts.append(prose(10) + " " + line + " " + prose(15))
        elif kind == 6:
            texts.append("a" * rng.randint(90, 400) + prose(3))
        elif kind == 7:
            texts.append((prose(12) + " ") * 6)
        elif kind == 8:
            texts.append(prose(rng.randint(1, 9)))
        else:
            texts.append(rng.choice(["", None, "   \n", prose(40).upper(), "x"]))
    texts.append(prose(3000))
    return [(i * 3, t, rng.choice(["en", "fr", None]), rng.choice(["s0", "s0", "s1", None]), len(t or "")) for i, t in enumerate(texts)]


def frame(spark, rows, parts: int = 5):
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)
