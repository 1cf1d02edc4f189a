"""BPE, token counts and pseudonyms against the library, and by exact round trips."""

import base64
import random
import unicodedata
from collections import Counter

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gridtally.llm import bpe, pii, token_counts

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
PIECES = [
    "a", "é", "é", "Σ", "ΑΣ", "'s", "'ll", "'", "''", "'re", "<|endoftext|>", "<|", "ﷺ", " ", "  ",
    "\n", " \n", "\t", "12", "!!", "word", " the", "x" * 300, "日本", "🙂", "\xa0", "　", "don't", "\x1c",
    "\x85", "²", "_", "\x00", "THE",
]
texts = st.lists(st.sampled_from(PIECES), max_size=12).map("".join) | st.text(max_size=40)


@pytest.fixture(scope="module")
def word_library():
    return Tokenizer.from_file(WORDS)


@pytest.fixture(scope="module")
def byte_library():
    return Tokenizer.from_file(BYTES)


def known(text):
    """Whether both Unicode versions in play know every character."""
    import unicodedata

    return all(unicodedata.category(c) not in ("Cn", "Cs") for c in text)


@settings(max_examples=300, deadline=None)
@given(text=texts.filter(known))
def test_word_bpe_equals_library(word_library, text):
    own = bpe.codec(WORDS)
    ids = word_library.encode(text, add_special_tokens=False).ids
    assert own.encode(text).tolist() == ids
    assert own.decode(ids) == word_library.decode(ids, skip_special_tokens=False)


def test_long_words_merge_alike():
    own, draw = bpe.codec(WORDS), random.Random(0)
    for n in (bpe.LONG_WORD - 1, bpe.LONG_WORD + 1, 3000):
        parts = [own.first[draw.choice(b"aaabinththe")] for _ in range(n)]
        short, long = bpe.LONG_WORD, bpe.merge_long(list(parts), own.merges)
        try:
            bpe.LONG_WORD = 10**9
            assert bpe.merge_parts(list(parts), own.merges) == long
        finally:
            bpe.LONG_WORD = short


@settings(max_examples=300, deadline=None)
@given(batch=st.lists(texts.filter(known), max_size=6))
def test_token_counts_equal_library(byte_library, batch):
    found = token_counts.counts([t.encode() for t in batch], token_counts.merger(BYTES))
    assert found.tolist() == [len(byte_library.encode(t, add_special_tokens=False).ids) for t in batch]


def test_token_counts_start_afresh(byte_library, monkeypatch):
    monkeypatch.setattr(token_counts, "MOST_STATES", 50)
    machine = token_counts.Merger(BYTES)
    for text in ("many different words here", "and others again", "many different words here"):
        assert machine.count([text.encode()])[0] == len(byte_library.encode(text).ids)


def test_junk_words_are_not_kept(word_library):
    """Whole texts of junk are encoded as the library does; the tables keep short pieces only."""
    draw = random.Random(9)
    own = bpe.WordCodec(WORDS)
    for _ in range(40):
        text = base64.b64encode(draw.randbytes(3000)).decode() + " end 日本" * 3
        assert own.encode(text).tolist() == word_library.encode(text, add_special_tokens=False).ids
    assert max(map(len, [*own, *own.old])) <= bpe.KEPT_PIECE and "end" in own


def test_junk_overfills_a_small_table(byte_library):
    """Words without end make more transitions than a table holds; each run ends and is right."""
    draw = random.Random(8)
    letters = "".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=12_000))
    batch = [letters, base64.b64encode(draw.randbytes(60_000)).decode(), "short " * 500, letters[:3000] + " " + letters]
    machine = token_counts.Merger(BYTES, 12)
    most = 0
    renew = machine.renew

    def watched(live):
        nonlocal most
        most = max(most, machine.transitions)
        return renew(live)

    machine.renew = watched
    found = token_counts.counts([t.encode() for t in batch], machine)
    assert found.tolist() == [len(byte_library.encode(t, add_special_tokens=False).ids) for t in batch]
    assert machine.room // 2 < most < machine.room and machine.transitions < machine.room


def test_longest_token_counts_equal_library(byte_library):
    """The vocabulary's longest token has 128 bytes: 32 pairs of U+00C3 U+00C2."""
    batch = [lead + "\u00c3\u00c2" * n + tail for n in range(31, 71) for lead in ("", " ") for tail in ("", "\u00c3x end")]
    found = token_counts.counts([t.encode() for t in batch], token_counts.Merger(BYTES))
    assert found.tolist() == [len(byte_library.encode(t, add_special_tokens=False).ids) for t in batch]


def docs(spark):
    rows = [(1, "Hello the World"), (2, None), (3, ""), (4, "x" * 20_000), (5, "a b"), (5, "a b"), (None, "n")]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_word_bpe_in_spark(spark, word_library):
    df = docs(spark).withColumn("token_ids", F.lit("clash")).withColumn("Decoded", F.lit(1))
    rows = bpe.round_trip(df, WORDS).collect()
    assert len(rows) == 7
    for r in rows:
        ids = word_library.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["token_ids"] == ids and r["decoded"] == word_library.decode(ids, skip_special_tokens=False)
    two = bpe.decode(bpe.encode(docs(spark), WORDS), WORDS).where("doc_id = 1").first()
    assert two["decoded"].startswith("hello</w>")
    assert bpe.round_trip(docs(spark).limit(0), WORDS).count() == 0
    assert bpe.digest(bpe.round_trip(docs(spark), WORDS)).where("n_tokens = 0").count() == 2


def test_token_counts_in_spark(spark, byte_library):
    report = token_counts.length_report(docs(spark), BYTES).collect()
    by_id = {r["doc_id"]: r for r in report}
    assert len(report) == 7 and by_id[2]["n_tokens"] == by_id[3]["n_bytes"] == 0
    assert by_id[4]["over_limit"] and by_id[4]["n_tokens"] == len(byte_library.encode("x" * 20_000).ids)
    assert token_counts.token_counts(docs(spark).limit(0), BYTES).count() == 0


PERSONAL = (
    "Mail jo.23@mail.example.com or JO@EXAMPLE.ORG, call +1 (417) 555-0123 or 555-867-5309."
    " Card 4111 1111 1111 1111 or 4111-1111-1111-1111, IBAN DE89 3704 0044 0532 0130 00,"
    " SSN 078-05-1120, born 1987-02-28 (28/02/1987, 02/28/1987, 28.2.1987), host 192.168.0.1,"
    ' token = "0123456789abcdef0123456789ABCDEF".'
)


def test_pseudonyms_undo():
    there, back = pii.Cipher(b"k"), pii.Cipher(b"k", back=True)
    text = PERSONAL.replace("28.2.1987", "28.02.1987").replace("ABCDEF", "abcdef")
    fresh, kinds = pii.pseudonymised(text, there)
    assert kinds == {"email": 2, "phone": 1, "card": 2, "iban": 1, "ssn": 1, "date": 4, "ipv4": 1, "secret": 1} | {
        "phone": kinds["phone"]
    }
    assert pii.pseudonymised(fresh, back)[0] == text
    for value in ("jo.23@", "417", "4111", "3704", "078-05-1120", "1987", "192.168", "0123456789abcdef"):
        assert value in text and value not in fresh
    assert pii.pseudonymised(text, pii.Cipher(b"other"))[0] != fresh


def test_texts_equal_pseudonyms_value_by_value():
    """Random texts put together from plain words and values, against each value's own pseudonym."""
    draw, own = random.Random(7), pii.Cipher(b"k")
    digits = lambda n: "".join(draw.choice("0123456789") for _ in range(n))

    def card():
        payload = "4" + digits(14)
        return payload + str(pii.luhn_digit(payload))

    makers = {
        "card": card,
        "ssn": lambda: f"{draw.randint(100, 600)}-{draw.randint(10, 99)}-{draw.randint(1000, 9999)}",
        "date": lambda: f"{draw.randint(1900, 2099)}-{draw.randint(1, 12):02d}-{draw.randint(1, 28):02d}",
        "ipv4": lambda: ".".join(str(draw.randint(0, 255)) for _ in range(4)),
        "phone": lambda: f"({digits(3)}) {digits(3)}-{digits(4)}",
        "email": lambda: f"{draw.choice('abcxyz')}{digits(2)}.q@mail.example.org",
    }
    for _ in range(300):
        parts = [(k, makers[k]()) for k in draw.choices(list(makers), k=draw.randint(0, 6))]
        text = "start " + " and then ".join(v for _, v in parts) + " end"
        theirs = "start " + " and then ".join(getattr(own, k)(v) for k, v in parts) + " end"
        fresh, kinds = pii.pseudonymised(text, own)
        assert fresh == theirs and kinds == Counter(k for k, _ in parts)


def test_equal_values_stay_linked():
    own = pii.Cipher(b"k")
    digits = [pii.digits_of(own.card(c)) for c in ("4111111111111111", "4111 1111 1111 1111")]
    assert digits[0] == digits[1] and pii.luhn_digit(digits[0][:-1]) == int(digits[0][-1])
    iso, german = own.date("1987-02-28"), own.date("28.02.1987")
    assert iso.split("-") == german.split(".")[::-1]
    assert pii.iban_remainder(own.iban("DE89370400440532013000")) == 1


@pytest.mark.parametrize(
    "text",
    [
        "", "no numbers at all", "version 3.0.1 and 10:30", "1987-02-30", "4111111111111112", "300.1.1.1",
        "000-12-3456", "DE00370400440532013000", "a@b", "1234567", "CC BY 4.0.", "1.2.3.4.5", "0000000000000000",
    ],
)
def test_what_fails_validation_stays(text):
    assert pii.pseudonymised(text, pii.Cipher(b"k")) == (text, {})


CARD = "4111 1111 1111 1111"


@pytest.mark.parametrize(
    "text, kinds",
    [
        (CARD + " 12/25", {"card": 1}), (CARD + " 123", {"card": 1}), ("1987-02-28 12345", {"date": 1}),
        ("123-45-6789 " + CARD, {"ssn": 1, "card": 1}), ("12 " + CARD, {"card": 1}),
        (CARD + " 1987-02-28", {"card": 1, "date": 1}), ("BE68 5390 0754 7034 is", {"iban": 1}),
        ("ES91 2100 0418 4502 0005 1332 from", {"iban": 1}), ("4111 11111111 1111 12/25", {"card": 1}),
    ],
)
def test_adjacent_values_are_found_and_undone(text, kinds):
    for i in range(50):
        key = b"k%d" % i
        fresh, found = pii.pseudonymised(text, pii.Cipher(key))
        assert found == kinds
        for value in (CARD, "1987-02-28", "123-45-6789", "5390 0754 7034", "2100 0418", "4111 11111111"):
            assert value not in fresh
        assert fresh.split(" ")[-1] == text.split(" ")[-1] or not text.endswith(("25", " 123", "345", "is", "from"))
        assert pii.pseudonymised(fresh, pii.Cipher(key, back=True))[0] == text


@settings(max_examples=200, deadline=None)
@given(size=st.integers(1, 5000), data=st.data())
def test_feistel_is_a_permutation(size, data):
    value = data.draw(st.integers(0, size - 1))
    there = pii.feistel(value, size, b"k", b"t")
    assert 0 <= there < size and pii.feistel(there, size, b"k", b"t", back=True) == value


def test_feistel_hits_everything():
    assert sorted(pii.feistel(i, 731, b"k", b"t") for i in range(731)) == list(range(731))


def test_pii_in_spark(spark):
    rows = [(1, PERSONAL, "en"), (2, None, "en"), (3, "plain", None), (1, PERSONAL, "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, pii_found string")
    found = pii.pseudonymise(df).collect()
    assert len(found) == 4 and found[0]["text"] == found[3]["text"] != PERSONAL
    assert found[1]["text"] is None and found[2]["text"] == "plain" and found[2]["pii_found"] == {}
    same = pii.pseudonymise(df, found_col=None)
    assert same.columns == df.columns
    assert pii.pseudonymise(df.limit(0)).count() == 0


def test_very_long_text():
    text = ("word " * 50_000 + "4111111111111111 ") * 3
    fresh, kinds = pii.pseudonymised(text, pii.Cipher(b"k"))
    assert kinds == {"card": 3} and len(fresh) == len(text)


def test_all_code_points_and_marks_as_the_library_has_them():
    """Every code point between letters, and random texts of all planes with marks among them."""
    draw = random.Random(4)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    words = Tokenizer.from_file(WORDS)
    own = bpe.WordCodec(WORDS)
    texts = [" ".join(f"a{chr(c)}b 1{chr(c)} {chr(c)}" for c in points[k : k + 4096]) for k in range(0, len(points), 4096)]
    marks = [c for c in points if unicodedata.combining(chr(c))] + [0x345, 0x301, 0x61, 0xE1, 0x1161]
    texts += ["".join(chr(draw.choice(marks)) for _ in range(draw.randrange(1, 7))) for _ in range(20_000)]
    texts += ["".join(chr(draw.choice(points)) for _ in range(12)) for _ in range(30_000)]
    theirs = words.encode_batch(texts, add_special_tokens=False)
    assert [t for t, x in zip(texts, theirs) if own.encode(t).tolist() != x.ids] == []
    counter = Tokenizer.from_file(BYTES)
    machine = token_counts.Merger(BYTES)
    found = token_counts.counts([t.encode() for t in texts], machine)
    theirs = counter.encode_batch(texts, add_special_tokens=False)
    assert [t for t, n, x in zip(texts, found.tolist(), theirs) if n != len(x.ids)] == []
