"""Small corpora for the operators' tests."""

import random

EXTRA = "chunk long, rk long, kept boolean, n_tokens string, bucket int, h long, key string, block int, place int, n long, component_id string, label int, quality string"
FILL = (1, 2, None, "x", 3, 4, "k", 5, 6, 7, "c", 8, "q")
LONG = "lang wort " * 30_000


def random_texts(n=60, seed=3, vocabulary=40, most=120):
    """Texts with copies, near copies, shared passages and repeated lines."""
    r = random.Random(seed)
    words = ["".join(r.choices("abcdeéß", k=r.randint(1, 7))) for _ in range(vocabulary * 20)]
    passage = " ".join(r.choices(words, k=60))
    out = []
    for i in range(n):
        kind = i % 6
        if kind == 1 and out:
            text = r.choice(out)
        elif kind == 2 and out:
            w = r.choice(out).split(" ")
            for _ in range(max(1, len(w) // 40)):
                w[r.randrange(len(w))] = r.choice(words)
            text = " ".join(w)
        elif kind == 3:
            text = " ".join(r.choices(words, k=r.randint(0, 30))) + " " + passage + "\n" + " ".join(r.choices(words, k=r.randint(0, 30)))
        elif kind == 4:
            line = " ".join(r.choices(words, k=12))
            text = "\n".join([line] * r.randint(1, 8) + [" ".join(r.choices(words[:6], k=50))])
        else:
            text = " ".join(r.choices(words, k=r.randint(0, most)))
        out.append(text)
    return out


def table(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t) for i, t in enumerate(texts)], "doc_id long, text string")


def edge_rows():
    return [
        (1, "alpha beta gamma delta", "en", "s"), (2, None, None, None), (None, "alpha beta gamma delta", "en", "s"), (3, "", "en", "s"), (4, " \n\t ", "", ""),
        (1, "alpha beta gamma delta", "en", "s"), (5, LONG, "en", "s"), (6, LONG, "en", None), (7, "é" * 70 + " " + "😀" * 60, "en", "s"), (None, None, None, None), (8, "\x00 nul", "en", "s"),
    ]


def edge_table(spark):
    """Nulls, empty and long texts, ties, repeated rows, and extra columns with clashing names."""
    return spark.createDataFrame([r + FILL for r in edge_rows()], f"doc_id long, text string, lang string, source string, {EXTRA}").repartition(3)


def empty_table(spark):
    return spark.createDataFrame([], f"doc_id long, text string, lang string, source string, {EXTRA}")
