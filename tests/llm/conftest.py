import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows(seed=5, n=160):
    """Prose, near copies, exact copies, repeated rows, nulls in every column, empty and long texts."""
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdeilnorstu") for _ in range(rng.randint(2, 9))) for _ in range(400)] + ["ñandú", "größe", "été"]
    prose = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    out, texts = [], []
    for i in range(n):
        kind = i % 8
        if kind == 3 and texts:
            text = rng.choice(texts)
        elif kind == 5 and texts:
            w = rng.choice(texts).split(" ")
            for _ in range(max(1, len(w) // 60)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            text = " ".join(w)
        elif kind == 6:
            text = prose(20) + "\nAll rights reserved.\n" + prose(15) + "\n" + prose(3) + "\tLicensed under CC BY-NC 4.0.\n\n" + "same line again\n" * rng.randint(1, 6)
        else:
            text = prose(rng.randint(1, 120))
        texts.append(text)
        out.append((i, text, "en", f"src{i % 5}" if i % 11 else None, len(text)))
    out += [(n, None, None, None, None), (n + 1, "", "en", "src1", 0), (n + 2, " \n\t ", "en", "", 4), (n + 3, prose(9000), "de", "src2", 1), (n + 4, "one", "en", "src0", 3), (n + 5, "One\x0b", "en", "src0", 4)]
    return out


@pytest.fixture(scope="session")
def data():
    return rows()


@pytest.fixture(scope="session")
def docs(spark, data):
    return spark.createDataFrame(data, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def odd(spark, data):
    """The same with repeated rows, a null id, and columns whose names the operators use themselves."""
    more = [*data, data[7], data[7], (None, "a text without an id that is long enough to be kept by rules", "en", "src3", 1), (None, None, None, None, None)]
    clash = [(*r, "k", 1, 2, "x", 3) for r in more]
    return spark.createDataFrame(clash, SCHEMA + ", key string, size int, shard int, n string, chunk int")


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
