"""Models and counts come from all texts."""

import numpy as np
import pytest

from skein.llm import jaccard, spam_pages


def test_the_page_model_is_fitted_to_all_texts(spark):
    """As in memory, whatever the number of texts, their length and how they are stored; empty texts say nothing."""
    pages = ["The finance partner should check the second page. Nobody owned the folder.", "#cheap #buy #online\n#best #cheap #buy", "Home > Printer > New > Best\nHome > Printer > Top > Free", "one\ntwo words here\n\nAn auditor had to repeat the upload."]
    data = [(i, pages[i * i % 4] + f"\nline {i}" * (i % 3)) for i in range(9000)] + [(9000, "#tag #other #more\n" * 1500), (9001, ""), (9002, None)]
    want = spam_pages.fit(*spam_pages.observe([t for _, t in data if t]))
    df = spark.createDataFrame(data, "doc_id bigint, text string")
    for parts in (1, 5):
        got = spam_pages.fitted(spam_pages._observed(df.repartition(parts), "doc_id", "text"))
        assert all(np.allclose(x, y, rtol=0, atol=1e-10) for x, y in zip(got, want))


@pytest.mark.parametrize("texts", [300])
def test_phrases_are_counted_in_all_texts(spark, monkeypatch, texts):
    """Two shingles that part in a tenth of the texts and more are of no phrase, and each hot one is found, however few
    texts a sample would have had."""
    monkeypatch.setattr(jaccard, "PHRASE_TEXTS", 3, raising=False)
    found = []
    plain = jaccard._phrases
    monkeypatch.setattr(jaccard, "_phrases", lambda *args: found.append(plain(*args)) or found[-1])
    data = [(i, f"x{i} a b c d" + (" e f" if i % 8 else f" y{i} e f")) for i in range(texts)]
    jaccard.similar_texts(spark.createDataFrame(data, "id bigint, t string"), "id", "t", 0.6, 1, hot=20)
    keys, reps = found[0]
    code = lambda w: int(jaccard.shingles([w], 1)[0][0])
    of = dict(zip(keys.tolist(), reps.tolist()))
    assert set(of) == {code(w) for w in "abcdef"}
    assert len({of[code(w)] for w in "abcd"}) == 1 and of[code("e")] == of[code("f")] != of[code("d")]
