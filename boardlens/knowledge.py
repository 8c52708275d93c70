"""What is known about failure mechanisms, as data."""

from __future__ import annotations

SINGLE, COMPONENT, LOCAL, BOARD = "single_pad", "component_multi_pad", "local_area", "board_wide"

# Mechanisms in catalogue order. Direction, allowed verdicts of volume | area | height
# (a slash parts alternatives), usual extent, usual timing, whether drift announces it, automatic checks.
MECHANISMS = (
    ("aperture_clogging", "UNDER", "up|up/flat|up/flat", (SINGLE, COMPONENT, LOCAL), ("consecutive", "periodic"), True, ("trend_slope", "cleaning_marker")),
    ("poor_release", "UNDER", "up|flat|up", (SINGLE, LOCAL), ("consecutive", "repeated"), False, ("parameter_drift",)),
    ("understencil_residue", "OVER", "up|up|flat/up", (SINGLE, COMPONENT), ("consecutive", "periodic"), True, ("trend_slope", "cleaning_marker")),
    ("poor_gasketing", "BOTH", "flat/up|up|up", (LOCAL, COMPONENT), ("consecutive", "repeated"), False, ()),
    ("slump", "OVER", "flat|up|up", (BOARD, LOCAL), ("consecutive",), True, ("metric_signature",)),
    ("paste_rheology_drift", "BOTH", "any|any|any", (BOARD,), ("consecutive",), True, ("trend_slope",)),
    ("supply_interruption", "UNDER", "up|up|up", (BOARD,), ("sporadic",), False, ()),
    ("parameter_mismatch", "BOTH", "", (BOARD, LOCAL), ("consecutive",), False, ("parameter_drift", "recovery")),
    ("squeegee_one_side", "BOTH", "", (BOARD, LOCAL), ("repeated",), False, ("print_direction_split",)),
    ("cleaning_cycle_mismatch", "OVER", "", (SINGLE, LOCAL), ("periodic",), True,
     ("periodic_recurrence", "cleaning_frequency_reference", "cleaning_marker")),
    ("alignment_offset", "BOTH", "", (BOARD, LOCAL), ("consecutive",), False, ("mark_deviation_trend",)),
    ("spi_false_call", "BOTH", "", (SINGLE,), ("repeated",), False, ("spi_metric_mismatch",)),
    ("undetermined", "BOTH", "", (), (), False, ()),
)

# Automatic checks whose data are not there yet, and why.
UNAVAILABLE_CHECKS = {"mark_deviation_trend": "planned", "cleaning_marker": "not_collected", "print_direction_split": "not_collected"}

# Prior of a projected mechanism, of the fallback, and how many are projected.
PROJECTION_PRIOR, FALLBACK_PRIOR, PROJECTION_LIMIT = 0.45, 0.35, 3

# Extent and timing that a pattern of abnormals stands for.
PATTERN_AXES = {
    "POINT_REPEAT": (SINGLE, "repeated"), "BOARD_TREND": (BOARD, "sporadic"),
    "COMPONENT_MULTI_PAD": (COMPONENT, "sporadic"), "SPORADIC": (SINGLE, "sporadic"),
}

# Extents that a failure event's scope covers.
EVENT_EXTENTS = {"BOARD_WIDE": (BOARD,), "LOCAL": (SINGLE, COMPONENT, LOCAL)}

# The decision ladder. Step, order, and whether it nominates (the others adjust confidences).
STEPS = (
    ("spi_false_alarm_gate", 10), ("parameter_recovery", 20), ("parameter_drift", 21), ("periodic_recurrence", 30),
    ("scope_prior", 50), ("trend_shape", 60), ("mechanism_projection", 70),
)

# Priors of rules and factors of the confidence.
PRIORS = {"spi_false_alarm": "0.85", "recovery": "0.85", "periodic": "0.80", "drift": "0.75", "trend": "0.60"}
SCOPE_PRIORS = {
    (SINGLE, "OVER"): ("understencil_residue", "0.70"), (SINGLE, "UNDER"): ("aperture_clogging", "0.70"),
    (COMPONENT, "OVER"): ("understencil_residue", "0.70"), (COMPONENT, "UNDER"): ("aperture_clogging", "0.70"),
    (LOCAL, "OVER"): ("poor_gasketing", "0.65"), (LOCAL, "UNDER"): ("aperture_clogging", "0.65"),
    (BOARD, "OVER"): ("paste_rheology_drift", "0.65"), (BOARD, "UNDER"): ("supply_interruption", "0.65"),
}
DRIFT_GROUPS = (("snapoff", "poor_release"), ("sqg", "parameter_mismatch"), ("cleaning", "cleaning_cycle_mismatch"))
CROSS_MODEL, ALIGNED, SIGNATURE_MATCH, SIGNATURE_CONFLICT, TYPICAL, ATYPICAL, CONFIDENCE_CAP = "0.8", "1.15", "1.2", "0.7", "1.1", "0.9", "0.95"
ALIGNMENT_TOLERANCE = 0.2
LEVELS = (("0.75", "HIGH"), ("0.5", "MEDIUM"))

# What to do first, with its priority.
DISPOSITIONS = {
    "data_continuity_review": "P3", "spi_program_review": "P2", "immediate_field_check": "P1", "halt_and_contain": "P1",
    "confirm_primary_cause": "P2", "fast_single_point_check": "P3",
}

# Identifiers of the two defect directions, of the causes that are no mechanism, and the
# spellings under which a direction appears; a mechanism's identifier is its name after ``mech.``.
DIRECTION_CONCEPTS = {"OVER": "defect.over_volume", "UNDER": "defect.insufficient_volume"}
DIRECTION_LABELS = {
    "OVER": ("OVER", "多锡", "Over Volume", "过量"), "UNDER": ("UNDER", "少锡", "Insufficient Volume", "少量"),
}
CAUSE_CONCEPTS = {
    "trend_gradual": "root_cause.cumulative_state_degradation", "trend_step": "root_cause.discrete_process_change",
    "local_printing_state": "root_cause.local_printing_state",
}
