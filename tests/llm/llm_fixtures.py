import random
import re

import public_tokenizers
import pytest

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, band int, doc long, label long, n long, leaf long, pos int, line string, token string, row long, u long, id string, block long, copies long, source_key string, lang_key string, low double, members binary, k long, r long, drop string, _row int, _id long, start long, part int, in_target boolean"


def words(text):
    """Words as the contracts define them."""
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text, k, lower=True):
    """Distinct k-word shingles; a shorter text is one shingle."""
    w = words(lowered(text) if lower else text)
    if len(w) >= k:
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
    return {tuple(w)} if w else set()


def prose(seed, n, vocabulary=400):
    rng = random.Random(seed)
    names = ["".join(random.Random(i).choices("abcdefghiklmnoprstu", k=2 + i % 6)) for i in range(vocabulary)]
    return " ".join(rng.choice(names) for _ in range(n))


def twins(n):
    """Two words of ``n`` letters that collide under every polynomial modulo 2**64 with an odd base."""
    a = "a"
    while len(a) < n:
        a += a.translate(str.maketrans("ab", "ba"))
    return a, a.translate(str.maketrans("ab", "ba"))


ODD_ROWS = [
    (1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu.\nsecond line here", "en", "s1"),
    (1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu.\nsecond line here", "en", "s1"),
    (2, None, None, None),
    (3, "", "en", "s1"),
    (4, " \n\t \r\n", "fr", ""),
    (None, prose(1, 60), "de", "s2"),
    (5, "x", None, "s2"),
    (6, prose(2, 30_000), "en", None),
    (7, "é世界 <|endoftext|>   x" * 3, "zz", "s3"),
    (8, prose(1, 60), "de", "s2"),
    (9, "\x00 odd\x01 \U0001f600 </s>", "en", "s3"),
    *((10 + i, f"{w}\n{v}\n{w}", "en", "s1") for i, (v, w) in enumerate([twins(1024), twins(1024)[::-1], twins(2048), twins(2048)[::-1]])),
]


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in any column, empty, blank and very long texts, repeated rows, clashing names."""
    extra = SCHEMA.count(",") + 1 - 4
    return spark.createDataFrame([(*r, *[None] * extra) for r in ODD_ROWS], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_documents(odd_documents):
    return odd_documents.limit(0)


@pytest.fixture(scope="session")
def corpus(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
