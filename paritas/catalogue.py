"""Names the engine works with: identity columns, model phases, column headers."""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

# The identity score columns of the comment table, in the order
# in which every per-identity result is reported.
IDENTITY_COLUMNS = (
    "asian",
    "atheist",
    "bisexual",
    "black",
    "buddhist",
    "christian",
    "female",
    "heterosexual",
    "hindu",
    "homosexual_gay_or_lesbian",
    "intellectual_or_learning_disability",
    "jewish",
    "latino",
    "male",
    "muslim",
    "other_disability",
    "other_gender",
    "other_race_or_ethnicity",
    "other_religion",
    "other_sexual_orientation",
    "physical_disability",
    "psychiatric_or_mental_illness",
    "transgender",
    "white",
)

# Public metric headers of the CSV files, by internal column name.
METRIC_HEADERS = {
    "model": "Model",
    "identity": "Identity",
    "total_examples": "Total Examples",
    "overall_auc": "1. Overall AUC",
    "overall_fnr": "2. Overall FNR",
    "overall_fpr": "3. Overall FPR",
    "subgroup_auc": "4. Subgroup AUC",
    "subgroup_fnr": "5. Subgroup FNR",
    "subgroup_fpr": "6. Subgroup FPR",
}

METRIC_COLUMNS = (
    "overall_auc",
    "overall_fnr",
    "overall_fpr",
    "subgroup_auc",
    "subgroup_fnr",
    "subgroup_fpr",
)

BASELINE, RAW, FINETUNED, ZERO_SHOT = "baseline", "raw", "finetuned", "zero_shot"


class ModelSpec(NamedTuple):
    """A registered model: the name its predictions carry, and how it was made."""

    name: str
    phase: str

    @property
    def key(self) -> str:
        """Value of the ``model`` column in prediction and metric tables."""
        if self.phase == RAW:
            return f"{self.name} Raw"
        if self.phase == FINETUNED:
            return f"{self.name} Finetuned"
        if self.phase == ZERO_SHOT:
            return f"{self.name} Raw"
        return self.name

    @property
    def prediction_header(self) -> str:
        """Column of the compiled row-level prediction table."""
        if self.phase == RAW:
            return f"Raw {self.name}"
        if self.phase == FINETUNED:
            return f"Fine-tuned {self.name}"
        return self.name


def safe_name(model: str) -> str:
    """A model name that can be part of a file name."""
    return model.replace("/", "_")


def present_identities(columns: Iterable[str]) -> list[str]:
    """Identity columns a table has, in catalogue order (no job is run)."""
    present = set(columns)
    return [name for name in IDENTITY_COLUMNS if name in present]
