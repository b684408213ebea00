import public_tokenizers
import pytest

from corpusgraph.llm import tokens

PATHS = {name: public_tokenizers.path(name) for name in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model")}


def whole(path, texts):
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return [len(model.encode(t)) for t in texts]
    from tokenizers import Tokenizer

    return [len(Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids) for t in texts]


@pytest.mark.parametrize("name, chunk, overlap", [
    ("word_bpe_49k.json", 32768, 512), ("word_bpe_49k.json", 150, 40), ("byte_bpe_50k.json", 300, 60),
    ("piece_bpe_32k.model", 300, 60)])
def test_counts_equal_the_library_on_whole_texts(documents, messy, name, chunk, overlap):
    got = {r.doc_id: r for r in tokens.count_tokens(documents, PATHS[name], chunk, overlap).collect()}
    want = whole(PATHS[name], [t or "" for _, t, _ in messy])
    assert {i: got[i].n_tokens for i, _, _ in messy} == {r[0]: n for r, n in zip(messy, want)}
    assert {i: got[i].n_bytes for i, _, _ in messy} == {i: len((t or "").encode()) for i, t, _ in messy}


def test_no_rows_repeated_rows_and_null_ids(spark):
    path = PATHS["word_bpe_49k.json"]
    df = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b")], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.n_tokens) for r in tokens.count_tokens(df, path).collect()) == [
        ("1", 2), ("1", 2), ("None", 2)]
    assert tokens.count_tokens(df.limit(0), path).count() == 0
