"""Cross-field rules of pipelines, templates and center profiles, for ``metadata.violations``.

A rule is a Column that is true where it is kept. Presence tests never give null, so that a missing
value is a decision and not an unknown.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def given(*columns: str) -> Column:
    """All of the columns have values."""
    out = F.lit(True)
    for c in columns:
        out = out & F.col(c).isNotNull()
    return out


def absent(*columns: str) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & F.col(c).isNull()
    return out


def implies(premise: Column, conclusion: Column) -> Column:
    return ~F.coalesce(premise, F.lit(False)) | F.coalesce(conclusion, F.lit(False))


def pipeline_rules() -> dict[str, Column]:
    """Rules over inference_enabled, mode, threshold, sahi (a flag or struct), reconstruction_enabled, segments, degrees, model_bundle_id, intake, automatic."""
    infer, rebuild = F.col("inference_enabled"), F.col("reconstruction_enabled")
    return {
        "some_stage": infer | rebuild,
        "model_with_inference": implies(infer, given("model_bundle_id")),
        "no_model_without_inference": implies(~infer, absent("model_bundle_id")),
        "inference_settings": implies(infer, given("mode", "threshold")),
        "no_settings_without_inference": implies(~infer, absent("mode", "threshold", "sahi")),
        "slices_for_sahi": implies(infer & (F.col("mode") == "sahi"), given("sahi")),
        "no_slices_for_direct": implies(infer & (F.col("mode") == "direct"), absent("sahi")),
        "segments_with_reconstruction": implies(rebuild, given("segments", "degrees")),
        "no_segments_without_reconstruction": implies(~rebuild, absent("segments", "degrees")),
        "full_turn": implies(rebuild & given("segments", "degrees"), F.abs(F.col("segments") * F.col("degrees") - 360.0) <= 1e-6),
        "automatic_settings": (F.col("intake") == "automatic_folder") == given("automatic"),
    }


def template_rules(column: str = "filename_template") -> dict[str, Column]:
    """A file-name template has {cycle} and {position} once each, no other braces, and no unsafe characters."""
    t = F.col(column)
    times = lambda token: (F.length(t) - F.length(F.replace(t, F.lit(token), F.lit("")))) / len(token)
    rest = F.replace(F.replace(t, F.lit("{cycle}"), F.lit("")), F.lit("{position}"), F.lit(""))
    return {"one_cycle": times("{cycle}") == 1, "one_position": times("{position}") == 1, "no_other_braces": ~rest.rlike("[{}]"), "safe_characters": ~t.rlike('[\\\\/<>:"|?*]')}


def center_rules() -> dict[str, Column]:
    """Rules over side, strategy, plate_only, screens, angles, replaces_screens, offset, median_limit, most_limit."""
    upper, lower = F.col("side") == "upper", F.col("side") == "lower"
    plate, angles = F.col("plate_only"), F.coalesce(F.col("angles"), F.array().cast("array<double>"))
    return {
        "known_side": upper | lower,
        "plate_has_no_screens": implies(plate, ~F.col("screens") & (F.size(angles) == 0)),
        "assembly_has_screens": implies(~plate, F.col("screens")),
        "ten_angles": implies(~plate, (F.size(angles) == 10) & (F.size(F.array_distinct(angles)) == 10)),
        "upper_strategy": implies(upper, (F.col("strategy") == "upper_black_plate") & plate),
        "lower_strategy": implies(lower, (F.col("strategy") == "lower_complete_assembly") & ~plate & F.col("screens")),
        "upper_keeps_screens": implies(upper, ~F.col("replaces_screens")),
        "upper_has_no_offset": implies(upper, absent("offset")),
        "limits": F.col("median_limit") <= F.col("most_limit"),
    }


def progress_rules() -> dict[str, Column]:
    """Rules over an event's progress_current and progress_total."""
    current, total = F.col("progress_current"), F.col("progress_total")
    return {"progress_pair": current.isNull() == total.isNull(), "progress_within": current <= total}


def calibration_rules() -> dict[str, Column]:
    """Rules over roi_x, roi_y, roi_width, roi_height, input_width, input_height, inner_radius, outer_radius."""
    inside = (F.col("roi_x") + F.col("roi_width") <= F.col("input_width")) & (F.col("roi_y") + F.col("roi_height") <= F.col("input_height"))
    return {"roi_inside": inside, "radii": F.col("inner_radius") < F.col("outer_radius")}


def transform_set_rules(count: int = 16) -> dict[str, Column]:
    """Rules over one set's n, first, last, positions, hashes and masks (see ``metadata.transform_sets``)."""
    whole = (F.col("n") == count) & (F.col("first") == 1) & (F.col("last") == count) & (F.col("positions") == count)
    return {"positions": whole, "hashes": F.col("hashes") == count, "masks": F.col("masks") == count}


def same_names(a: Column, b: Column) -> Column:
    """Whether two lists hold the same names, whatever their order; repeats count once, null lists differ."""
    return F.coalesce(F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b)), F.lit(False))
