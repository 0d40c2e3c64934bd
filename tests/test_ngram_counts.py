"""N-grams counted as numbers: the same counts as plain ones, in bounded slices, exchanged packed or as terms."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from mailfeat.functions import text as X
from mailfeat.operators import batched_svm as S
from mailfeat.operators import corpus as V

TEXTS = ["win prize win prize win", "", None, "a bb a bb", "x", "ab abc ab a b abc", "win", "prize win prize"]


def _plain(text, n_min, n_max):
    words = [w for w in (text or "").split(" ") if len(w) >= 2]
    return Counter(" ".join(words[i : i + n]) for n in range(n_min, n_max + 1) for i in range(len(words) - n + 1))


@pytest.mark.parametrize(("n_min", "n_max"), [(1, 3), (1, 1), (2, 2), (2, 4), (1, 40)])
def test_counts(n_min, n_max):
    for size in (1, 20, 1 << 20):
        got = {}
        for a, b, c in X.ngram_counts(pa.array(TEXTS), n_min, n_max, size):
            for i, x in enumerate(X.term_lists(c).to_pylist()):
                assert [t["term"] for t in x] == sorted(t["term"] for t in x)
                got[a + i] = {t["term"]: t["tf"] for t in x}
        assert [got[i] for i in range(len(TEXTS))] == [dict(_plain(t, n_min, n_max)) for t in TEXTS]


def test_stats_by_number_by_term_and_by_list(spark, monkeypatch):
    rows = [(None if i % 5 == 0 else f"d{i % 2}", i, t) for i, t in enumerate(TEXTS * 3)]
    docs = V.with_terms(spark.createDataFrame(rows, "dataset string, msg_id int, clean string"))
    want = {}
    for ds, _, t in rows:
        for term, tf in _plain(t, 1, 3).items():
            df, total = want.get((ds, term), (0, 0))
            want[ds, term] = (df + 1, total + tf)
    sent = []
    monkeypatch.setattr(V, "_numbered_stats", lambda *a, real=V._numbered_stats: sent.append(1) or real(*a))
    got = lambda d, m: {(r.dataset, r.term): (r.df, r.tf_total) for r in V.term_stats(d, min_df=m).collect()}
    for m in (1, 2, 4):
        kept = {k: v for k, v in want.items() if v[0] >= m}
        assert got(docs, m) == kept
        assert got(docs.drop("clean"), m) == kept
    assert len(sent) == 3  # terms were exchanged as numbers
    monkeypatch.setattr(V, "WORDS", 2)
    assert got(docs, 2) == {k: v for k, v in want.items() if v[0] >= 2} and len(sent) == 3


def test_early_pruning_from_the_texts(spark, monkeypatch):
    """The same rows as the plain count; n-grams of one row, which are most, aren't counted, and no list of terms is made."""
    texts = [t for t in TEXTS if t] * 2 + [f"w{i}a w{i}b w{i}c win prize" for i in range(40)]
    rows = [(None if i % 5 == 0 else f"d{i % 2}", i, 0, t) for i, t in enumerate(texts)]
    docs = V.with_terms(spark.createDataFrame(rows, "dataset string, msg_id int, label int, clean string").repartition(3)).checkpoint()
    sizes, hits = V.corpus_size(docs), []
    got = lambda p: sorted((str(r.dataset), r.term, r.df, r.tf_total) for r in V.frequent_stats(docs, sizes, p).collect())
    want = {m: got(V.BodyParams(min_df=m)) for m in (1, 2, 4)}
    monkeypatch.setattr(V.B, "without_singletons", lambda *a: pytest.fail("term lists"))
    monkeypatch.setattr(V, "_seen_again", lambda *a, real=V._seen_again: hits.append(real(*a)) or hits[-1])
    for words in (V.WORDS, 2):  # n-grams by number, by spelling
        monkeypatch.setattr(V, "WORDS", words)
        for m in want:
            assert want[m] and got(V.BodyParams(min_df=m, prune_early=True)) == want[m]
    assert len(hits) == 4 and all(0 < np.unpackbits(x.value).sum() < 60 for x in hits)
    monkeypatch.setattr(V.B, "MIN_SLOTS", 64)
    monkeypatch.setattr(V.B, "MAX_SLOTS", 64)  # every slot is shared
    monkeypatch.setattr(V.B, "USELESS", 10**9)
    assert got(V.BodyParams(min_df=2, prune_early=True)) == want[2]
    monkeypatch.setattr(V.B, "USELESS", 0)
    assert got(V.BodyParams(min_df=2, prune_early=True)) == want[2] and hits[-1] is None


def test_a_pass_reads_what_its_machines_need():
    key = lambda cond, kernel: (S.Key("d", cond, 0, 0, 0, kernel, 1.0), 0.5, 3)
    assert S._needed(S._groups([key("body_only", "rbf")]), "label") == ["dataset", "label", "z_body_only", "q_body_only"]
    assert S._needed(S._groups([key("fusion", "linear")]), "label") == ["dataset", "label", "i_fusion", "v_fusion"]
