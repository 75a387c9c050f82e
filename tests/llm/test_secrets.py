"""The token test finds random strings of several alphabets and leaves prose, identifiers and digests alone."""

import random
import string

import pytest

from tessera.llm import secrets

IDENTIFIERS = (
    "x86_64-linux-gnu-gcc-12 internationalization_of_documents_2024 getHTTPResponseCodeOrDefault Donaudampfschifffahrtsgesellschaft 2024-01-01T00:00:00Z "
    "application/x-www-form-urlencoded node_modules/lodash/fp/curryRightN AbstractSingletonProxyFactoryBean antidisestablishmentarianism HELLO_WORLD_CONSTANT_3 "
    "d41d8cd98f00b204e9800998ecf8427e123e4567 123e4567-e89b-12d3-a456-426614174000 4111111111111111 ================ sha256-47DEQpj8HBSa+/TImW+5JCeuQeRkm5NMpJWZG3hSuFU="
)


@pytest.fixture(scope="module")
def encode():
    with open(secrets.VOCABULARY, "rb") as f:
        return secrets._encoder(f.read()).encode_ordinary


@pytest.mark.parametrize(("alphabet", "least"), [
    (string.ascii_letters + string.digits, (0.95, 0.98)), (string.ascii_letters, (0.85, 0.92)), (string.ascii_lowercase, (0.15, 0.9)),
    (string.ascii_lowercase + string.digits, (0.85, 0.98)), (string.ascii_uppercase + "234567", (0.85, 0.97)), (string.ascii_letters + string.digits + "+/", (0.95, 0.98)),
])
def test_recall_on_random_strings(encode, alphabet, least):
    rng = random.Random(17)
    for n, want in ((16, least[0]), (20, least[1]), (40, least[1])):
        runs = ["".join(rng.choices(alphabet, k=n)) for _ in range(300)]
        assert sum(bool(secrets.random_spans(f"the {r} of", encode, [])) for r in runs) >= want * 300


def test_identifiers_and_digests_are_left_alone(encode):
    assert [w for w in IDENTIFIERS.split() if secrets.random_spans(w, encode, [])] == []


def test_runs_inside_base_spans_are_not_repeated(encode):
    text = "token=Zq8vX2mLp0RtY7wKd3NbGh5JcSf9Ae and Zq8vX2mLp0RtY7wKd3NbGh5JcSf9Ae"
    base = secrets.base_spans(text)
    assert base == [(0, 0, 36)] and secrets.random_spans(text, encode, base) == [(41, 3, 71)]


def test_hard_rows(spark):
    rows = [(1, None, 5), (1, "", 5), (2, "é" * 40_000, 5), (3, "AKIA" + "A" * 16 + " token: abcdef", 5), (3, "AKIA" + "A" * 16 + " token: abcdef", 5)]
    got = sorted(tuple(r) for r in secrets.op2_secrets(spark.createDataFrame(rows, "doc_id BIGINT, text STRING, spans INT")).select("doc_id", "spans").collect())
    assert got == [(1, ""), (1, ""), (2, ""), *[(3, "access:0:20,assign:21:34")] * 2]
