"""Queries that bind the operators to the test tables, each beside the SQL that must give the same rows."""

from __future__ import annotations

from gneiss.queries import audits, fields, fixtures, kernels, ladders, panels, predicates, reports, semantics, typed

MODULES = (panels, ladders, fields, audits, kernels, predicates, typed, reports, semantics, fixtures)

#: Queries over Python kernels (spectra, eigenvalues, sequential random streams), which have no SQL.
ROWS_ONLY = frozenset(
    "ge12_correlation_spectrum ge10_graph_spectrum ge22_concentration_norm "
    "si5_escape_trials si2_ladder_points ag48_power_by_cell ag49_simulated_power ag63_fragility si11_suite si14_threshold_calibration".split())


def queries() -> dict:
    return {name: function for module in MODULES for name, function in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for module in MODULES for name, text in module.SQL.items()}
