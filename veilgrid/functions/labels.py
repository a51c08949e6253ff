"""Classifiers: rule tables expressed as CASE columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import finite, col

# Land-cover class codes of each group.
LANDCOVER_CODES = {
    "cropland": [40],
    "built_up": [50],
    "water_wetland_mangrove": [80, 90, 95],
    "vegetation_non_crop": [10, 20, 30, 100],
    "bare_sparse": [60],
}

# Numeric codes of three enumerations.
ANCHOR_CODES = {
    "sparse_gnss_anchor": 0.0,
    "weak_or_missing_gnss_anchor": 1.0,
    "control_or_specification_case": -1.0,
}
SIGNAL_CODES = {"inconclusive": 0.0, "positive": 1.0, "strong_positive": 2.0}
LANDCOVER_ORDER_CODES = {
    "cropland": 0.0,
    "vegetation_non_crop": 1.0,
    "built_up": 2.0,
    "water_wetland_mangrove": 3.0,
}

# Status text and result labels of the readiness and candidate rules.
PENDING_STATUS = "query_pack_ready_token_required"
READY_WITH_TRUTH_PENDING = "conditional_nature_go_after_egms"
READY_ANCHORED = "benchmark_v0_landed_needs_dense_truth"
READY_UNANCHORED = "statistical_signal_needs_independent_anchor"
READY_CONTROL = "control_or_specification_case"
READY_NO = "do_not_lead"
ROLE_BY_NAME = {
    "Mexico_City": "extreme_subsidence_anchor_case",
    "Central_Valley_large": "dense_us_control_and_methods_validation",
}
ROLE_JAPAN = "japan_licsbas_extension_case"
ROLE_STRONG = "strong_gnss_subsidence_candidate"
ROLE_DENSE = "dense_gnss_deformation_candidate"
ROLE_OTHER = "secondary_candidate"
NEXT_JAPAN = "selective Zenodo LiCSBAS city zip download plus GEONET/GSI or NGL station overlay"
NEXT_BY_NAME = {
    "Mexico_City": "open InSAR deformation product plus GHSL/Google buildings exposure overlay",
    "Central_Valley_large": "area-weighted exposure overlay and source-data packaging",
}
NEXT_OTHER = "independent dense deformation benchmark and exposure overlay"


def code_map(c: Column | str, codes: dict[str, float]) -> Column:
    """Named value to number; anything unknown is NULL."""
    out = F.lit(None).cast("double")
    for name, value in codes.items():
        out = F.when(col(c) == name, F.lit(value)).otherwise(out)
    return out


def landcover_group(code: Column | str) -> Column:
    out = F.lit("other")
    for group, codes in LANDCOVER_CODES.items():
        out = F.when(col(code).isin(codes), F.lit(group)).otherwise(out)
    return out


def signal_class(odds, lo, hi) -> Column:
    """Direction of an odds ratio judged by its interval; values that are not finite count as missing."""
    odds, lo, hi = col(odds), col(lo), col(hi)
    missing = ~(finite(odds) & finite(lo) & finite(hi))
    return (
        F.when(missing, "missing")
        .when((lo > 1) & (odds >= 3), "strong_positive")
        .when(lo > 1, "positive")
        .when(hi < 1, "negative")
        .otherwise("inconclusive")
    )


def readiness_class(signal, n_anchor, status) -> Column:
    positive = col(signal).isin("strong_positive", "positive")
    anchored = col(n_anchor) >= 5
    return (
        F.when(positive & anchored & (col(status) == PENDING_STATUS), READY_WITH_TRUTH_PENDING)
        .when(positive & anchored, READY_ANCHORED)
        .when(positive, READY_UNANCHORED)
        .when(col(signal) == "inconclusive", READY_CONTROL)
        .otherwise(READY_NO)
    )


def priority_tier(n) -> Column:
    return F.when(col(n) >= 20, "A").when(col(n) >= 5, "B").otherwise("C")


def candidate_role(name, n, median) -> Column:
    out = F.when(col(n) >= 20, F.when(col(median) < -1, ROLE_STRONG).otherwise(ROLE_DENSE)).otherwise(ROLE_OTHER)
    named = F.when(col(name).startswith("Japan"), ROLE_JAPAN).otherwise(out)
    for key, role in ROLE_BY_NAME.items():
        named = F.when(col(name) == key, role).otherwise(named)
    return named


def next_data_needed(name) -> Column:
    out = F.when(col(name).startswith("Japan"), NEXT_JAPAN).otherwise(NEXT_OTHER)
    for key, text in NEXT_BY_NAME.items():
        out = F.when(col(name) == key, text).otherwise(out)
    return out


def probe_status(name, n_probes, any_filtered, target: str = "Japan_Niigata") -> Column:
    """Ingestion state of the one probed candidate; empty text for all others."""
    return (
        F.when(col(name) != target, "")
        .when(F.coalesce(col(n_probes), F.lit(0)) == 0, "not_run")
        .when(col(any_filtered), "niigata_h5_velocity_ingested")
        .otherwise("niigata_zip_downloaded")
    )


def transfer_status(signal, status) -> dict[str, Column]:
    """Support flags of a regional transfer row."""
    token = col(status).contains(PENDING_STATUS)
    ok = col(signal).isin("positive", "strong_positive") & token
    return {
        "status": F.when(ok, "supported").when(col(signal) == "inconclusive", "control").otherwise("partial"),
        "directional_support": ok.cast("int"),
        "token_required": token.cast("int"),
    }


def subsidence_supported(fraction, count) -> Column:
    """External product shows enough subsidence over enough cells."""
    return (col(fraction) >= 0.15) & (col(count) > 10000)


def coverage_supported(count, median) -> Column:
    """Nationwide product is large and its mask is centred on zero."""
    return (col(count) > 1_000_000) & (col(median) == 0.0)


def signal_group(signal) -> Column:
    return (
        F.when(col(signal).isin("positive", "strong_positive"), "signal_positive")
        .when(col(signal) == "inconclusive", "control_spec")
        .otherwise("other")
    )


def family_category(family) -> Column:
    return (
        F.when(col(family) == "summary_only_meta", "summary_only")
        .when(col(family).startswith("blocked_equal_area"), "region_level")
        .when(col(family) == "hierarchical_anchor_stack", "cell_anchored")
        .otherwise("stratified_control")
    )


def bbox_reject_reason(w, s, e, n, max_side: float = 5.0) -> Column:
    """NULL for a usable query box, else why it is refused."""
    width, height = col(e) - col(w), col(n) - col(s)
    return F.when((width <= 0) | (height <= 0), "invalid_bbox").when(
        (width > max_side) | (height > max_side), "exceeds_side_limit"
    )


def require_valid_bbox(w, s, e, n, max_side: float = 5.0) -> Column:
    """Strict form: TRUE, or the job fails with the reason."""
    reason = bbox_reject_reason(w, s, e, n, max_side)
    return F.when(reason.isNull(), F.lit(True)).otherwise(F.raise_error(reason).cast("boolean"))


def exposure_account(strong, observed) -> Column:
    """The four classes of deformation screen by observability."""
    return (
        F.when(col(strong) & col(observed), "visible_exposure")
        .when(col(strong), "hidden_exposure_retained")
        .when(col(observed), "observable_background")
        .otherwise("low_support_background")
    )


def composite_score(loo_share_gt1, pooled_or, hidden, transfer, specificity, reproducibility) -> dict[str, Column]:
    """Stability and weighted score of one evidence stack."""
    stability = col(loo_share_gt1) * F.least(F.lit(1.0), col(pooled_or) / 2.0)
    score = (
        0.35 * stability + 0.25 * col(hidden) + 0.20 * col(transfer)
        + 0.10 * col(specificity) + 0.10 * col(reproducibility)
    )
    return {"effect_stability": stability, "composite_score": score}
