import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from kohorta.llm.pieces import AS_IT_IS, Normalizer, PieceModel, encode_pieces, fields
from kohorta.llm.queries import QUERIES

NAME = "piece_bpe_32k.model"
ODD = ["", " ", "   ", "a", " a  b ", "tab\tline\n\nend \r\n", "naïve Ⅷ ﬁn ①② ㌔ ｶﾞ é ﷺ", "　wide　 blank​", "中文 ñ 😀 \U0010ffff",
       "x\0y", "</s> <s> <unk> <0x41>", "▁ ▁▁", "ｶﾞﾊﾟ" * 40, "ﬁ" * 9 + " é ", "one two three", "q" * 3000]


@pytest.fixture(scope="module")
def model():
    with open(public_tokenizers.path(NAME), "rb") as file:
        return file.read()


def changed(model, spec):
    """The model with another normaliser in place of its own."""
    def number(x):
        return bytes([x & 127 | (128 if x > 127 else 0)]) + (number(x >> 7) if x > 127 else b"")
    out = b""
    for key, value in fields(model):
        if key != 3:
            out += number(key << 3 | 2) + number(len(value)) + value
    return out + number(3 << 3 | 2) + number(len(spec)) + spec


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc", "nmt_nfkc_cf"])
def test_normaliser_equals_the_library(rule):
    theirs = sentencepiece.SentencePieceNormalizer(rule_name=rule)
    ours = Normalizer(theirs.serialized_normalizer_spec())
    for text in ODD:
        written, places = ours(text.encode())
        assert written.decode() == theirs.normalize(text)
        assert len(places) == len(written) + 1 and (places[1:] >= places[:-1]).all() and places[-1] <= len(text.encode())


@pytest.mark.parametrize("rule", [None, "nmt_nfkc", "nfkc"])
def test_pieces_equal_the_library_and_point_at_their_source(model, rule):
    if rule:
        model = changed(model, sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_normalizer_spec())
    made, library = PieceModel(model), sentencepiece.SentencePieceProcessor(model_proto=model)
    for text, (ids, starts, ends) in zip(ODD, made.encode([t.encode() for t in ODD])):
        assert ids == library.encode(text)
        assert len(starts) == len(ends) == len(ids) and (starts[1:] == ends[:-1]).all()
        source = text.encode()
        for i, a, b in zip(ids, starts, ends):
            piece = library.id_to_piece(int(i))
            if rule is None:
                want = bytes([int(piece[3:5], 16)]) if library.is_byte(int(i)) else piece.replace("▁", " ").encode()
                assert source[a:b].replace("▁".encode(), b" ") in (want, want.removeprefix(b" "))


def test_projection_through_replacements(model):
    spec = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_normalizer_spec()
    made = PieceModel(changed(model, spec))
    text = "  ﬁne   Ⅷ "
    (ids, starts, ends), = made.encode([text.encode()])
    spans = [(made.library.id_to_piece(i), text.encode()[a:b].decode()) for i, a, b in zip(ids, starts, ends)]
    assert "".join(p for p, _ in spans) == "▁fine▁VIII"
    assert "".join(s for _, s in spans) == "ﬁne   Ⅷ"


def test_whole_and_tricky_texts(spark, tricky, texts, nothing):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(NAME))
    got = encode_pieces(tricky, NAME).collect()
    want = [(i, library.encode(t or "", add_eos=True)) for i, t in texts]
    key = lambda x: (x[0] is None, x[0], x[1])
    assert sorted(((r.doc_id, r.ids) for r in got), key=key) == sorted(want, key=key)
    assert all(r.decoded == library.decode(r.ids) and len(r.ids) == len(r.starts) == len(r.ends) for r in got)
    assert encode_pieces(nothing, NAME).collect() == []
    assert encode_pieces(tricky, NAME, end=False).where(F.size("ids") == 0).count() == 2


def test_model_kinds_that_are_refused(model):
    with pytest.raises(ValueError):
        PieceModel(model + b"\x0a\x07\x0a\x03zzq\x18\x04")
    assert len(AS_IT_IS) < 128


def test_query(spark):
    import hashlib
    location = "/root/testdata/sf0.001"
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(NAME))
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{location}/documents.parquet").collect()}
    rows = QUERIES["op12_piece_spans"](spark, location).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id], add_eos=True)
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids)))
