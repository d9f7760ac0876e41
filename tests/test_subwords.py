import pytest
from pyspark.sql import functions as F

from skeinwork.text.subwords import _LETTERS, BytePairs, Frame, Normalizer, WordPiece, words

FRAME = Frame(cls=1, sep=2, pad=0, unk=3)


def test_normal_form_and_words():
    assert Normalizer()("Ça\x00 ÉTÉ 中文") == "ca ete 中  文 ".replace("ete 中", "ete  中")
    assert Normalizer(lower=False, accents=True)("Été") == "Été"
    assert words("it's a-b  c") == ["it", "'", "s", "a", "-", "b", "c"]
    assert words("it's a-b", "whitespace") == ["it's", "a-b"] and words("a b", "none") == ["a b"] and words("", "none") == []


def test_word_pieces(spark):
    vocab = {"play": 10, "##ing": 11, "##ed": 12, "!": 13, "un": 14, "##play": 15, "##able": 16}
    pieces = WordPiece(vocab, FRAME)
    assert pieces.encode("Playing unplayable! zzz", 10) == [1, 10, 11, 14, 15, 16, 13, 3, 2, 0]
    assert pieces.encode("playing played", 4) == [1, 10, 11, 2] and pieces.encode("playing", 1) == [1] and pieces.encode("x", 0) == []
    assert pieces.encode(None, 3) == [1, 2, 0] and pieces.mask([1, 2, 0]) == [1, 1, 0]
    got = spark.createDataFrame([("played",), (None,)], "t string").select(pieces.column(F.col("t"), 4).alias("ids")).collect()
    assert [r.ids for r in got] == [[1, 10, 12, 2], [1, 2, 0, 0]]


def test_byte_pairs_equal_the_library():
    tokenizers = pytest.importorskip("tokenizers")
    blank = _LETTERS[32]
    merges = ["a b", "ab c", f"{blank} a", f"{blank}a b", "c c", "é".encode().decode("latin-1")[0] + " " + "é".encode().decode("latin-1")[1]]
    vocab = {s: k + 10 for k, s in enumerate([*_LETTERS, *dict.fromkeys(m.replace(" ", "") for m in merges)])}
    mine = BytePairs(vocab, FRAME, Normalizer(False, False, False, True), "whitespace", merges)
    model = tokenizers.models.BPE(vocab=vocab, merges=[tuple(m.split(" ")) for m in merges])
    library = tokenizers.Tokenizer(model)
    library.pre_tokenizer = tokenizers.pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    for text in ("abc", "abcabc cccc", "ab ab abc", "é ab", "xyz"):
        ids = mine.encode(text, 40)
        want = [i for k, w in enumerate(text.split(" ")) for i in library.encode(" " + w if k else w).ids]
        assert ids[1 : 1 + len(want)] == want and ids[1 + len(want)] == FRAME.sep
