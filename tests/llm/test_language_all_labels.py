"""The language stage's model and thresholds come from all labelled texts, however many a language has."""

import random
from collections import Counter

import numpy as np
import pytest

from parquarry.llm import langid


def test_model_and_thresholds_of_all_labelled_texts(spark, monkeypatch):
    r = random.Random(4)
    syllables = {"aa": "ba de li mo".split(), "bb": "xu xy zaq qe".split()}
    n = {"aa": langid.MAX_DOCS + 1503, "bb": 42}
    data = [(x, " ".join("".join(r.choices(syllables[x], k=2)) for _ in range(r.randint(1, 6)))) for x, many in n.items() for _ in range(many)]
    data += [("aa", "same words")] * 300 + [("aa", "1 2"), ("bb", "")]
    docs = spark.createDataFrame([(i, t, x) for i, (x, t) in enumerate(data)] + [(-1, None, "aa"), (-2, "no label", None)], "doc_id long, text string, lang string").repartition(3)
    seen = {}
    usual = langid.usual

    def spy(model, *rest):
        seen["model"], seen["usual"] = model, usual(model, *rest)
        return seen["usual"]

    monkeypatch.setattr(langid, "usual", spy)
    langid.keep(docs)
    model, shown = seen["model"], seen["usual"]
    assert model.languages == ["aa", "bb"]
    size = {}
    for k, x in enumerate(model.languages):
        texts = [langid.normalise(t) for y, t in data if y == x]
        count = Counter(np.concatenate([c for c, _ in langid.grams(texts, langid.COLUMNS)]).tolist())
        size[x] = sum(count.values()) + langid.COLUMNS
        want = np.log([(count[c] + 1) / size[x] for c in range(langid.COLUMNS)])
        assert model.by_column[:, k] == pytest.approx(want, abs=1e-5)
    for k, x in enumerate(model.languages):
        *_, mean, many = model.judge([t for y, t in data if y == x], usual=True)
        low, half = np.percentile(mean[many > 0], [25, 50])
        assert shown.middle[k] == pytest.approx(half, abs=1e-12)
        assert shown.between[k] == pytest.approx((half - low) * 1.4826, abs=1e-12)


def test_quartiles_as_percentile_has_them(spark):
    r = random.Random(5)
    values = {0: [-7.0], 1: [-3.0, -5.5], 2: [r.gauss(-8, 0.01) for _ in range(1001)] + [-8.0] * 77, 3: [-4.25] * 9, 4: [r.uniform(-30, 0) for _ in range(398)]}
    df = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs], "lang int, mean double").repartition(3)
    got = langid._quartiles(df)
    assert got.keys() == values.keys()
    assert all(got[k] == pytest.approx(list(np.percentile(vs, [25, 50])), abs=1e-12) for k, vs in values.items())
