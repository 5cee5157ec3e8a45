import hashlib
import random

import numpy as np
import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F

from quirespark.llm.pieces import load_pieces, marked
from quirespark.llm.token_counts import PrefixCounter, longest_within, token_counts, tokens_of_prefix
from quirespark.llm.unigram import Unigram, decode, encode

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
PIECES = load_pieces(PATH)


def test_every_prefix_count_is_the_librarys():
    counter, rng = PrefixCounter(PIECES), random.Random(3)
    texts = ["", " ", "   x", "The  quick\n\tbrown fox's <s> </s> ▁▁ naïve 漢字 🙂\x00end ", "e" * 90, " " * 40 + "\n" + " " * 3]
    texts += ["".join(rng.choice("abehinort eé ▁\n漢t  h") for _ in range(rng.randrange(60))) for _ in range(60)]
    for t in texts:
        assert counter.prefix_counts(t).tolist() == [len(LIBRARY.encode(t[:k])) for k in range(len(t) + 1)], t


def test_counts_of_documents(docs, odd, empty):
    want = {i: t or "" for i, t in docs.select("doc_id", "text").collect()}
    rows = token_counts(docs, PATH, limit=300, with_prefixes=True).withColumn("half", tokens_of_prefix("prefix_deltas", F.lit(40))).collect()
    assert len(rows) == len(want)
    for r in rows:
        t = want[r["doc_id"]]
        n = len(LIBRARY.encode(t))
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(t.encode()), n, n > 300)
        assert len(LIBRARY.encode(t[: r["fit_chars"]])) <= 300
        if r["fit_chars"] < len(t):
            assert len(LIBRARY.encode(t[: r["fit_chars"] + 1])) > 300
        assert np.frombuffer(r["prefix_deltas"], np.int8).sum() == n and r["half"] == len(LIBRARY.encode(t[:40]))
    assert token_counts(odd, PATH).count() == 7 and token_counts(empty, PATH).count() == 0


def test_longest_prefix_where_counts_fall():
    assert longest_within(np.array([0, 1, 2, 3, 2, 3]), 2) == 4


def brute(unit: str, coder: Unigram) -> float:
    best = {0: 0.0}
    for end in range(1, len(unit) + 1):
        options = [best[k] + PIECES.scores[PIECES.ids[unit[k:end]]] for k in range(end) if unit[k:end] in PIECES.ids]
        if unit[end - 1] not in PIECES.ids:
            options.append(best[end - 1] + coder.unknown)
        best[end] = max(options)
    return best[len(unit)]


def test_viterbi_is_the_best_of_all():
    coder, rng = Unigram(PIECES), random.Random(4)
    for _ in range(300):
        unit = "▁" + "".join(rng.choice("abeghinorst漢é") for _ in range(rng.randrange(1, 12)))
        ids = coder.best(unit)
        unknown = sum(c not in PIECES.ids for c in unit)
        plain = [i for i in ids if i not in PIECES.byte_ids]
        assert sum(PIECES.scores[i] for i in plain) + unknown * coder.unknown == brute(unit, coder)


def test_trie_holds_every_piece():
    t = Unigram(PIECES).trie
    for name, i in PIECES.ids.items():
        s = 0
        for c in name:
            assert t.check[to := t.base[s] + t.codes[c]] == s
            s = to
        assert t.value[s] == i


def test_encode_and_decode(docs, odd, empty):
    want = {i: t or "" for i, t in docs.select("doc_id", "text").collect()}
    rows = decode(encode(docs, PATH), PATH).collect()
    for r in rows:
        assert r["text"] == want[r["doc_id"]] and r["round_trip"] and r["n_tokens"] == len(r["ids"])
        assert r["decoded_sha256"] == hashlib.sha256(want[r["doc_id"]].encode()).hexdigest()
        assert LIBRARY.decode(r["ids"]) == r["text"]
    assert len(rows) == len(want) and encode(odd, PATH).count() == 7 and encode(empty, PATH).count() == 0


def test_units_lose_nothing():
    for t in ["", "a  b\n\tc ", "▁x▁"]:
        assert "".join(PIECES.units.findall(marked(t))) == marked(t)
