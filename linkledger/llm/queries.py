"""The queries of this subpackage by name."""

from __future__ import annotations

from . import bit_slices, class_lm, decontaminate, filter_audit, language, mixing, near_duplicates, neighbours, periodic, repeats, secrets, sharding, token_files

QUERIES = {
    f.__name__: f
    for f in (
        repeats.op1_repeats,
        decontaminate.op2_decontaminate,
        neighbours.op3_neighbours,
        language.op4_language,
        sharding.op5_sharding,
        near_duplicates.op6_near_duplicates,
        secrets.op7_secrets,
        mixing.op8_mixing,
        token_files.op9_token_files,
        class_lm.op10_class_lm,
        periodic.op11_periodic_runs,
        bit_slices.op12_bit_sliced_top,
        filter_audit.op13_filter_audit,
    )
}
ORACLES: dict[str, str] = {**sharding.ORACLES, **secrets.ORACLES, **mixing.ORACLES, **bit_slices.ORACLES, **filter_audit.ORACLES}
