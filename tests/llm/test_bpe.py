import base64

import hypothesis
import public_tokenizers as P
import tiktoken
from hypothesis import strategies as st

from sunledger.llm import bpe

from .conftest import ODD

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
with open(RANKS, "rb") as _f:
    _CONTENT = _f.read()
CODEC = bpe.ByteBpe(_CONTENT)
OWN = tiktoken.Encoding("own", pat_str=P.PATTERN, special_tokens={},
                        mergeable_ranks={base64.b64decode(t): int(r) for t, r in map(bytes.split, _CONTENT.splitlines())})


def ids(text):
    return ",".join(map(str, OWN.encode_ordinary(text)))


@hypothesis.given(st.text(alphabet=st.sampled_from("ab \n\t'sé日1!_-́ ßt"), max_size=40))
@hypothesis.settings(max_examples=400, deadline=None)
def test_equals_the_library(text):
    assert CODEC.encode(text) == ids(text) and CODEC.decode(ids(text)) == text.encode()


def test_trees_side_by_side_equal_single_trees():
    words = [bytes([97 + i * j % 7 for j in range(i % 60 + 1)]) for i in range(300)] + [b"thnd", b"x"]
    assert CODEC.merge_many(words) == [CODEC.merge(w) for w in words]


def test_long_pieces_and_slices():
    texts = ["ab" * 20_000, "", "one two  three", " lead", "trail ", *(f"w{i} v{i * i}" for i in range(500))]
    assert list(bpe.ByteBpe(_CONTENT).encode_all(texts)) == [ids(t) for t in texts]


def test_round_trip_of_odd_rows(spark, documents):
    docs = documents(ODD)
    back = bpe.decode_documents(spark, bpe.encode_documents(spark, docs, RANKS), RANKS)
    assert sorted(bytes(r.decoded) for r in back.collect()) == sorted((t or "").encode() for _, t in ODD)
    report = {(r.doc_id, r.n_tokens) for r in bpe.bpe_report(spark, docs, RANKS).collect()}
    assert report == {(i, len(OWN.encode_ordinary(t or ""))) for i, t in ODD}
    assert bpe.bpe_report(spark, documents([]), RANKS).count() == 0
