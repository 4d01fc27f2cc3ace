"""Profiles kept up to date while a table grows."""

from __future__ import annotations

from pyspark.sql import DataFrame

from rowassay.operators.profile_state import estimated_profile, merge_states, profile_state
from rowassay.sources.store import ResultStore


def add_rows(store: ResultStore, dataset_id: str, appended: DataFrame) -> str:
    """Scan only the appended rows and store their state; returns the run id. Running it twice counts the rows twice."""
    return store.append("profile_states", profile_state(appended), dataset_id)


def grown_profile(store: ResultStore, dataset_id: str, top_limit: int = 10) -> DataFrame:
    """The profile of everything added so far, from the stored states alone: no table is read."""
    return estimated_profile(merge_states(store.read("profile_states", dataset_id)), top_limit)
