"""Independent models and chains side by side."""

import numpy as np
import pandas as pd
import pytest

from aquifer.operators import models


def test_modes_hold_what_the_single_models_give(spark):
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=(2, 400))
    g1 = (a + 0.5 * rng.normal(size=400) > 0).astype(float)
    pdf = pd.DataFrame({"sample_id": range(400), "a": a, "b": b, "g1": g1, "g2": np.where(rng.random(400) < 0.9, g1, 1 - g1),
                        "l1": (b > 0).astype(float), "one": 1.0, "class": "clash"})
    df = spark.createDataFrame(pdf)
    tr, te = df.where("sample_id % 4 > 0"), df.where("sample_id % 4 = 0")
    classes = spark.createDataFrame([(n, "A", i) for i, n in enumerate(["g1", "g2", "l1", "one", "never"])], "analyte string, class string, ord int")
    got = {r["analyte"]: r for r in models.compare_modes(tr, te, ["a", "b"], ["g1", "g2"], ["one", "l1"], classes, max_iter=2).collect()}
    alone = {r["analyte"]: r for r in models.independent_gbt(tr, te, ["a", "b"], ["g1", "g2", "l1"], 2)[0].collect()}
    chain = {r["analyte"]: r for r in models.chain_gbt(tr, te, ["a", "b"], ["g1", "g2"], 2).collect()}
    assert len(got) == 5
    for n in ("g1", "g2", "l1"):
        assert got[n]["independent_auroc"] == pytest.approx(alone[n]["auroc"]) and got[n]["n_train"] == alone[n]["n_train"]
    assert got["g2"]["global_chain_auroc"] == pytest.approx(chain["g2"]["auroc"]) and got["g2"]["local_chain_auroc"] is None
    for n in ("g1", "g2", "l1"):
        scores = {m: got[n][f"{m}_auroc"] for m in ("independent", "global_chain", "local_chain") if got[n][f"{m}_auroc"] is not None}
        assert got[n]["best_mode"] == max(scores, key=scores.get)
    assert got["l1"]["local_chain_auroc"] > 0.9
    for n in ("one", "never"):  # one class only, and an analyte that no model holds
        assert got[n]["best_mode"] is None and got[n]["independent_auroc"] is None
