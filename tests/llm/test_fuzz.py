"""Random texts: exactness where a fast path stands for a plain one."""

import re

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer, models

from brooklet.llm import media, ngram_join, packing, pii, tokens

JUDGE = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
ENCODER = packing.WordEncoder(open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read())
ODD = "aAbsS'tvmdlr.,!?*#%& \n\t\x0b\x1c\x85 éÉßÿ÷×µıİΣσςKǺ̇ﬁ½²3٣𝒳😀<|endoftext|>’"
TEXT = st.one_of(st.text(alphabet=ODD, max_size=60), st.text(max_size=40), st.lists(st.sampled_from(["it's", "Word.", "naïve,", "ÉCOLE!", "don't", "a'b's", "'s", "x2y", "***", "end.##", "Straße", "İst", "ét", "3.14", "<|startoftext|>x", "<|ENDOFTEXT|>", "<|Endoftext|>", "<|endoftext|>", "<|startofTEXT|>É", "W<|STARTOFTEXT|>", "ABC", "A<|B"]), max_size=12).map(" ".join))


@settings(max_examples=400, deadline=None)
@given(TEXT)
def test_packed_ids_are_the_tokenizers(text):
    assert ENCODER.encode([text], 2)[0].tolist() == JUDGE.encode(text, add_special_tokens=False).ids + [2]


VOCAB = [(p, s) for p, s in tokens.zipf_vocab(public_tokenizers.path("piece_bpe_32k.model"))]
LOW = min(s for _, s in VOCAB)
COUNTER = tokens.UnigramCounter(VOCAB)
UNIGRAM = Tokenizer(models.Unigram([("<unk>", LOW), *VOCAB, *[(f"<0x{i:02X}>", LOW) for i in range(256)]], 0, True))


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(alphabet="abcdethingsé▁ñß漢字😀.,", min_size=1, max_size=30), st.text(min_size=1, max_size=20)))
def test_counts_are_the_unigram_models(text):
    word = re.sub(r"[\x20\x09-\x0D]", "", text)
    if word:
        assert COUNTER.best("▁" + word)[1] == len(UNIGRAM.encode("▁" + word).ids)


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet="ab1.@-_ %", max_size=40))
def test_emails_are_the_patterns(text):
    assert list(pii.emails(text)) == [m.span() for m in EMAIL.finditer(text)]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=200))
def test_media_round_trip(text):
    raw = text.encode("utf-8", "replace")
    payload = media.padded(raw)
    assert len(payload) % 64 == 0 and payload and media.read_back(media.stored(payload)) == payload and payload[: len(raw)] == raw


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 400), min_size=1, max_size=80))
def test_windows_hold_each_item_once(sizes):
    parts = packing.windows_of(sizes, 512)
    assert sorted(i for p in parts for i in p) == list(range(len(sizes))) and all(sum(sizes[i] for i in p) <= 512 for p in parts)


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(0)
    for _ in range(20):
        a = np.unique(rng.integers(0, 2**63, 600).astype(np.uint64))
        b = np.unique(np.r_[a[:500], rng.integers(0, 2**63, 100).astype(np.uint64)])
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs((ngram_join.signature(a) == ngram_join.signature(b)).mean() - true) < 0.17


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["bob @ mail.archive.longdepartmentname.universityofsomewhere.example.com", "ann@x.org", "10.0.0.1", "4539 1488 0343 6467", "(988) 555-2485", "word", "a.b", "lorem ipsum dolor sit amet", "v1.2.33", "@", "7", "x" * 70]), max_size=14).map(" ".join))
def test_spans_are_those_of_decoding_every_window(text):
    """Windows that are skipped change nothing that counts."""
    tagger, width = pii.trained(60, 12), 128
    stride, margin = width // 2, width // 4
    last = max(0, -(-(len(text) - width) // stride))
    x = np.zeros((last + 1, width), np.int16)
    for w in range(last + 1):
        own = pii.codes(text[w * stride : w * stride + width])
        x[w, : len(own)] = own
    path = np.zeros(len(text), np.int8)
    for w, labels in enumerate(tagger.decode(x)):
        a, b = 0 if w == 0 else margin, width if w == last else margin + stride
        own = path[w * stride + a : w * stride + b]
        own[:] = labels[a : a + len(own)]
    kind = (path + 1) // 2
    begins = (kind > 0) & ((path % 2 == 1) | (np.r_[0, kind[:-1]] != kind)) if len(text) else np.zeros(0, bool)
    want = []
    for a in np.flatnonzero(begins).tolist():
        b = a + 1
        while b < len(path) and kind[b] == kind[a] and not begins[b]:
            b += 1
        if re.search("[0-9@]", text[a:b]):
            want.append((a, int(kind[a]) - 1, b))
    assert [s for s in pii.model_spans(tagger, [text])[0] if re.search("[0-9@]", text[s[0] : s[2]])] == want
