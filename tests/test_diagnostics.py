"""Diagnoses against plain loops over the same rows."""

import random
import statistics

import numpy as np
import pytest

from fieldlens.operators import diagnostics as D

SCHEMA = "id long, source string, known_3 double, known_5 double, known_10 double, sim_logging double, sim_wildfire double, p double, first string, second string, truth string"


def made(seed, n):
    rng, rows = random.Random(seed), []
    for i in range(n):
        own = i % 3 > 0
        base = rng.random() * (0.5 if own else 0.8)
        known = [round(0.5 + base - 0.3 * (not own) * rng.random() - d, 6) for d in (0, 0.03, 0.05)]
        rows.append((i, D.REFERENCE if own else "MINED", *known, rng.randint(0, 9) / 10, rng.randint(0, 9) / 10, rng.randint(0, 20) / 20, rng.choice(["Logging", "Wildfire", "", None]), rng.choice(["Logging", "Wildfire", None]), rng.choice(["Logging", "Wildfire", None]) if own else None))
    return rows


def kind(a, b):
    if not a and not b:
        return "NO_MODEL_LABELS"
    if not b:
        return "REMOTECLIP_ONLY"
    if not a:
        return "XGBOOST_ONLY"
    return f"AGREE_{a.upper()}" if a == b else f"RC_{a.upper()}_XGB_{b.upper()}"


def test_flags_and_diagnoses_equal_the_loop(spark):
    rows = made(1, 400)
    tables = D.diagnose(spark.createDataFrame(rows, SCHEMA))
    edge = np.quantile([r[3] for r in rows if r[1] == D.REFERENCE], 0.05)
    found = {r["id"]: r for r in tables["rows"].collect()}
    why = {}
    for i, source, _, known, _, log, fire, p, a, b, _ in rows:
        unknown = known < edge
        unsure = not unknown and 0.4 <= p <= 0.6
        assert (found[i]["unknown_flag"], found[i]["ambiguous_flag"], found[i]["agreement_type"]) == (unknown, unsure, kind(a, b))
        said = None
        if kind(a, b) == "RC_LOGGING_XGB_WILDFIRE":
            said = "OOD_BY_MANUAL_P05" if unknown else "AMBIGUOUS_0_4_0_6" if unsure else "IN_DISTRIBUTION_LOGGING_LIKE" if log >= fire else "WILDFIRE_LIKE_LATENT_CONFLICT"
        assert found[i]["diagnosis"] == said
        if said and source != D.REFERENCE:
            why[said] = why.get(said, 0) + 1
    assert {r["diagnosis"]: r["events"] for r in tables["disagreement_diagnosis"].collect()} == why and len(why) > 2
    for r in tables["agreement_summary"].collect():
        some = [x for x in rows if x[1] != D.REFERENCE and kind(x[8], x[9]) == r["agreement_type"]]
        assert r["events"] == len(some) and abs(r["knownness_k5_median"] - statistics.median(x[3] for x in some)) < 2e-6 and abs(r["similarity_margin_mean"] - statistics.mean(abs(x[5] - x[6]) for x in some)) < 2e-6


def test_shift_overlap_and_ranks_equal_the_loop(spark):
    rows = made(2, 500)
    tables = D.diagnose(spark.createDataFrame(rows, SCHEMA))
    own, other = [r for r in rows if r[1] == D.REFERENCE], [r for r in rows if r[1] != D.REFERENCE]
    at = {3: 2, 5: 3, 10: 4}
    shift = tables["domain_shift"].collect()
    assert len(shift) == 6
    for r in shift:
        c = at[int(r["metric"].removeprefix("knownness_k"))]
        edge = np.quantile([x[c] for x in own], r["manual_quantile"])
        below = sum(x[c] < edge for x in other)
        assert r["below_events"] == below and abs(r["below_share"] - below / len(other)) < 1e-6 and abs(r["manual_threshold"] - edge) < 1e-6
    overlap = tables["lowest_overlap"].collect()
    assert len(overlap) == 9
    for r in overlap:
        n = r["events_per_set"]
        a, b = ({x[0] for x in sorted(own, key=lambda x: (x[c], x[0]))[:n]} for c in (at[r["left_k"]], at[r["right_k"]]))  # noqa: B023
        assert n == int(np.ceil(len(own) * r["bottom_fraction"])) and r["intersection"] == len(a & b) and abs(r["jaccard"] - len(a & b) / len(a | b)) < 1e-6
    ranks = {r["pair"]: r for r in tables["rank_agreement"].collect()}
    assert len(ranks) == 6 and 0.9 < ranks["knownness_k3/k5"]["spearman"] <= 1 and abs(ranks["p/sim_logging"]["spearman"]) < 0.2


@pytest.mark.parametrize("rows", [[], [(1, "MINED", 0.5, 0.5, 0.5, 0.1, None, None, None, "Wildfire", None)]])
def test_without_a_reference_nothing_is_unknown(spark, rows):
    tables = D.diagnose(spark.createDataFrame(rows, SCHEMA))
    assert [r["unknown_flag"] for r in tables["rows"].collect()] == [False] * len(rows)
    assert tables["lowest_overlap"].isEmpty() and tables["rank_agreement"].isEmpty() and all(r["below_events"] == 0 for r in tables["domain_shift"].collect())
