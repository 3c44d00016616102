"""Compare the two record systems."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from slotlog.operators import cleaning, validation
from slotlog.session import cut_lineage


def validate(observations: DataFrame, slot_df: DataFrame, test_patient_ids: Sequence = (),
             machines: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Confusion matrix and set overlap. Both slot tables are read several times, so they are written once."""
    if machines is not None:
        slot_df = cleaning.keep_values(slot_df, "EnteringOrganisationDeviceID", machines)
    observed = cut_lineage(validation.observed_slots(observations, test_patient_ids).select(
        "patient_id", "date", "start_time", "slot_outcome"), "observed")
    derived = cut_lineage(slot_df.select("MRNCmpdId", "start_time", "slot_outcome"), "derived")
    return validation.confusion_matrix(observed, derived), validation.jaccard(observed, derived)
