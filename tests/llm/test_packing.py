import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from stratatile.llm import packing


def best_fit(lengths, limits):
    """One piece at a time, longest first, into the sequence that the limits' rule scores least; contents of the sequences."""
    bins, caps = [], limits.caps
    for n in sorted(lengths, reverse=True):
        need = np.array([n, 1.0, n * n])
        fits = [b for b in bins if (b[0] >= need).all()]
        if fits:
            b = min(fits, key=lambda b: float(limits.after(b[0], need)))
        else:
            b = [caps.copy(), []]
            bins.append(b)
        b[0] = b[0] - need
        b[1].append(n)
    return sorted(b[1] for b in bins)


@pytest.mark.parametrize("documents, attention", [(10**6, 10**9), (3, 10**9), (10**6, 5000), (4, 4000)])
@pytest.mark.parametrize("weights", [(1.0, 0.0, 0.0), (1.0, 0.5, 0.5), (1.0, 0.01, 0.01), (1.0, 1.0, 1.0)])
@pytest.mark.parametrize("choose", ["residual", "dot"])
def test_plans_hold_every_limit_and_equal_packing_one_at_a_time(documents, attention, weights, choose):
    rng = random.Random(4)
    for _ in range(25):
        limits = packing.Limits(100, documents, attention, weights, choose)
        top = 60 if attention < 10**9 else 100
        lengths = [rng.choice([rng.randint(1, top), 7, 50]) for _ in range(rng.randint(1, 200))]
        counts = {n: lengths.count(n) for n in set(lengths)}
        runs, total = packing.plan_bins(counts, limits)
        used = [[0, 0, 0] for _ in range(total)]
        spots, contents = [set() for _ in range(total)], [[] for _ in range(total)]
        for n, some in runs.items():
            ranks = []
            for rank, first, sequences, each, offset in some:
                for q in range(sequences * each):
                    s, o = first + q // each, offset + q % each * n
                    ranks.append(rank + q)
                    used[s] = [used[s][0] + n, used[s][1] + 1, used[s][2] + n * n]
                    contents[s].append(n)
                    span = set(range(o, o + n))
                    assert not span & spots[s]
                    spots[s] |= span
            assert sorted(ranks) == list(range(counts[n]))
        assert all(u[0] <= 100 and u[1] <= documents and u[2] <= attention and u[1] for u in used)
        assert all(s == set(range(u[0])) for s, u in zip(spots, used, strict=True))
        assert sorted(contents) == best_fit(lengths, limits)


def test_default_limits_use_all_three_dimensions():
    limits = packing.Limits()
    assert min(limits.weights) > 0
    _, total = packing.plan_bins({1: 3000}, limits)
    assert total == 3  # the number of documents is reached before the tokens are
    assert packing.plan_bins({4096: 2, 4: 1024}, limits)[1] == 3


def test_a_piece_that_fits_nowhere():
    with pytest.raises(ValueError, match="fits no sequence"):
        packing.plan_bins({50: 1}, packing.Limits(100, 5, 100))
    assert packing.plan_bins({}, packing.Limits())[1] == 0


def test_ids_equal_the_tokenizers(docs, rows, monkeypatch):
    monkeypatch.setattr(packing, "CACHE_WORDS", 500)
    whole = Tokenizer.from_file(packing.tokenizer_path())
    own = packing.WordTokenizer(packing.tokenizer_path())
    odd = ["It's WE'LL 'tis '", "a.b,c!!! $$$ ***", "ÀÉß ÿ µ ª", "é ́", "ΑΣ ΣΑΣ İ ǅ", "a\x1cb\x85c d", "12³ ½ 3a", "<|startoftext|>x<|endoftext|>", "\x00\x01", "漢字 かな 한글", "a‍b", "\U0001f600!", "d'r 's's"]
    for text in [r[1] or "" for r in rows] + odd:
        assert own.ids(text.encode()) == np.array(whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text[:80]


def test_every_row_is_packed_without_gaps(spark, docs, rows):
    got = packing.pack_documents(docs, with_ids=True, limits=packing.Limits(tokens=256, documents=256, attention=256**2)).collect()
    whole = Tokenizer.from_file(packing.tokenizer_path())
    want = []
    for r in rows:
        ids = [*whole.encode(r[1] or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), 256)):
            part = np.array(ids[at : at + 256], "<u4")
            want.append((r[0] is None, r[0] or 0, k, at, len(part), zlib.crc32(part.tobytes())))
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(want)
    assert all(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] for r in got)
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for some in by.values():
        at = 0
        for offset, length in sorted(some):
            assert offset == at
            at += length
        assert at <= 256
    assert len(by) == len(best_fit([w[4] for w in want], packing.Limits(256, 256, 256**2)))


def test_other_tokenizers_take_their_whole_path(tmp_path):
    import json

    path = packing.tokenizer_path()
    assert isinstance(packing.tokenizer(path), packing.WordTokenizer)
    given = json.load(open(path, encoding="utf-8"))
    given["normalizer"] = None
    other = tmp_path / "other.json"
    other.write_text(json.dumps(given), encoding="utf-8")
    for file in (str(other), packing.tokenizer_path("byte_bpe_50k.json")):
        text = "It's a  Test, of Ünï code\n"
        want = np.array(Tokenizer.from_file(file).encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        assert isinstance(packing.tokenizer(file), packing.WholeTokenizer) and packing.tokenizer(file).ids(text.encode()) == want


def test_empty_table(empty):
    assert packing.pack_documents(empty).count() == 0
