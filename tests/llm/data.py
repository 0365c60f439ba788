"""Small tables with every odd case: null and repeated ids, null, empty and long texts, ties, clashing columns."""

import random

import numpy as np

LETTERS = ["ab", "tion", "the", "on", "re", "is", "ü", "é", "日本"]


def sentence(rng, n):
    return " ".join("".join(rng.choice(LETTERS) for _ in range(rng.randint(1, 3))) + rng.choice(["", "", "", ",", "."]) for _ in range(n))


def odd_rows(seed=1, n=40):
    rng = random.Random(seed)
    rows = [(k, sentence(rng, rng.randint(1, 120)), "en", "s") for k in range(n)]
    copy = rows[3][1]
    rows += [(100 + k, copy, "en", "hot") for k in range(20)]  # a group of copies
    rows += [(200, copy + " more words here", "en", "s"), (201, None, "en", "s"), (202, "", None, None), (203, "  \n\t ", "en", "s"), (None, "no id", "en", "s"), (None, None, None, None)]
    rows += [(204, "x" * 5000, "en", "s"), (205, sentence(rng, 6000), "en", "s"), (7, rows[7][1], "en", "s"), (7, "same id, other text", "en", "s"), (206, "a▁b  c d\n\ne \U0001f600\x00 <|endoftext|>", "en", "s")]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string"


def odd_docs(spark, seed=1, n=40):
    """With columns whose names the operators use themselves."""
    docs = spark.createDataFrame(odd_rows(seed, n), SCHEMA).repartition(3)
    return docs.selectExpr("*", "'x' as score", "1 as fp", "2 as part", "3 as tie", "4 as kind", "5 as length", "'k' as key", "6 as component_id", "7 as held_out", "8 as _id", "9 as y")


def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def by_python(text):
    """Text as the contract's words: A-Z lower-cased, split at ASCII white space."""
    import re

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x20\x09-\x0d]+", low)


def labelled(spark, n=400, seed=3):
    """Documents whose quality and toxicity follow simple rules, and their labels."""
    rng = random.Random(seed)
    docs, labels = [], []
    for k in range(n):
        bad, toxic = rng.random() < 0.3, rng.random() < 0.3
        words = sentence(rng, rng.randint(30, 90)).split()
        if bad:
            words = [w + "***" for w in words]
        if toxic:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(["vermin", "wretch"]))
        docs.append((k, " ".join(words), "en", "s"))
        labels.append((k, int(not bad), int(toxic)))
    labels += [(None, 1, 1), (0, None, None), (1, 7, 7), (9_999, 1, 1)]
    return spark.createDataFrame(docs + odd_rows()[40:], SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), np.array(labels[:n], object)
