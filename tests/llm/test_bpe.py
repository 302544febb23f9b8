import pytest

from folioscope.llm import bpe

PATH = f"{bpe.TOKENIZER_DIR}/byte_bpe_50k.json"
TEXTS = [
    "", None, "   ", "aaaaaaaaa aaaa", "Binanananuba an an", "<|endoftext|> x", "日本語テキスト" * 50, "\n\n\n a", "ab" * 5000, "a\r\n\tb  c", "can't WE'LL 12345 é́  end ",
    "👩‍💻 ⚠️", "x" * 3000, " wide space", "a" * 7 + "b" * 7,
]


@pytest.fixture(scope="module")
def wanted():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    return [tokenizer.encode(t or "", add_special_tokens=False).ids for t in TEXTS]


def test_matches_the_library(wanted):
    own = bpe.PairIndexEncoder(PATH)
    for _ in range(2):  # the second time from the words known
        offsets, ids = own.encode(TEXTS)
        assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])] == wanted


def test_random_words_match():
    import random

    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(PATH)
    r = random.Random(5)
    texts = ["".join(r.choice("anbAN eé1'-\n") for _ in range(r.randint(0, 40))) for _ in range(2000)]
    own = bpe.PairIndexEncoder(PATH, cache_words=50)
    offsets, ids = own.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])] == [x.ids for x in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_table(spark, wanted):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(1, "again", "x"), (None, "again", "x")], "doc_id bigint, text string, ids string")
    rows = bpe.token_ids(df, "doc_id", "text", block_chars=100).collect()
    assert len(rows) == len(TEXTS) + 2
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, []).append(r.ids)
    assert all(wanted[i] in got[i] for i in range(len(TEXTS))) and len(got[1]) == 2 and got[None] == got[1][1:] or got[None] in ([got[1][0]], [got[1][1]])
    assert bpe.token_ids(df.limit(0), "doc_id", "text").count() == 0
    counts = {r.doc_id: r.n_tokens for r in bpe.token_counts(df.where("doc_id > 1"), "doc_id", "text").collect()}
    assert counts == {i: len(w) for i, w in enumerate(wanted) if i > 1}


def test_ids_give_the_texts_back(spark):
    texts = ["plain words", "", None, " \t\n", "日本語 Ünï 🙂\r\n", "a" * 3000, "\x00\x7f‍", "<|endoftext|>"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r.doc_id: r.text for r in bpe.decoded_texts(bpe.token_ids(df, "doc_id", "text"), "doc_id", "ids").collect()}
    assert got == {i: t or "" for i, t in enumerate(texts)}
