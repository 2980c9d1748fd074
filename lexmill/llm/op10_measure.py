"""Figures of op10: of settings, cross-fitted on the rows it may learn from, or of the held-out rows.

``python -m lexmill.llm.op10_measure SF_DIR`` compares settings; with ``held_out`` after it,
scores the held-out rows with the settings as they are.
"""

from __future__ import annotations

import sys

import numpy as np
from pyspark.sql import functions as F

from ..session import local_session
from . import op10_toxicity as op
from ._common import table

#: Settings compared, each against the module's own.
SETTINGS = (
    {}, {"SEGMENT": 16}, {"SEGMENT": 32, "UNIT": 8}, {"CHANCE": 1}, {"CHANCE": 30}, {"LIFT": 1.5}, {"WORDS": 6, "STEP": 3}, {"WORDS": 12, "STEP": 6},
    {"LEVEL": 3}, {"COMMON": 0}, {"BEYOND": (2, 4, 6)},
)


def auc(values: np.ndarray, y: np.ndarray) -> float:
    """The chance that a toxic value is above an ordinary one; ties count half."""
    good, bad = values[y == 1], np.sort(values[y == 0])
    return float((np.searchsorted(bad, good, "left") + np.searchsorted(bad, good, "right")).sum() / (2 * len(good) * len(bad)))


def settings(docs, labels) -> None:
    for s in SETTINGS:
        before = {k: getattr(op, k) for k in s}
        for k, v in s.items():
            setattr(op, k, v)
        m = op.Model(docs, labels)
        recall = {loss: float((m.values[m.y == 1] > np.quantile(m.values[m.y == 0], 1 - loss)).mean()) for loss in (0.01, 0.02, 0.03)}
        print(s or "as they are", f"AUC {auc(m.values, m.y):.3f}", *(f"recall {r:.3f} at a clean loss of {x}" for x, r in recall.items()), flush=True)
        for k, v in before.items():
            setattr(op, k, v)


def held_out(docs, labels) -> None:
    scored = op.toxicity(docs.select("doc_id", "text"), labels).where("held_out")
    rows = scored.join(labels.where(F.col("toxic").isin(0, 1)), "doc_id").join(docs.select("doc_id", "lang", "n_chars"), "doc_id").toPandas()
    y, p = rows["toxic"].to_numpy(), rows["predicted"].to_numpy()
    print(f"{len(y)} rows, {int(y.sum())} toxic: AUC {auc(rows['score'].to_numpy(), y):.3f}, caught {int(p[y == 1].sum())}, clean rejected {int(p[y == 0].sum())}")
    for lang, g in rows.groupby("lang"):
        print(lang, f"caught {int(g['predicted'][g['toxic'] == 1].sum())} of {int(g['toxic'].sum())}, clean rejected {int(g['predicted'][g['toxic'] == 0].sum())} of {int((g['toxic'] == 0).sum())}")
    for (low, high), g in ((b, rows[(rows["n_chars"] >= b[0]) & (rows["n_chars"] < b[1]) & (rows["toxic"] == 0)]) for b in ((0, 600), (600, 3000), (3000, 9000), (9000, 1 << 40))):
        print(f"clean, {low} to {high} characters: rejected {int(g['predicted'].sum())} of {len(g)}")


def main() -> None:
    spark = local_session(app="op10-measure")
    spark.sparkContext.setLogLevel("ERROR")
    docs, labels = table(spark, sys.argv[1], "documents"), table(spark, sys.argv[1], "labels", "doc_id", "toxic")
    (held_out if sys.argv[2:] == ["held_out"] else settings)(docs, labels)


if __name__ == "__main__":
    main()
