"""Names the roles of a table's columns; every operator takes one of these."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class TableSpec:
    """``key`` is unique per row, ``feats`` are the numeric columns, ``label`` the class."""

    key: str
    feats: tuple[str, ...]
    label: str | None = None

    def __post_init__(self):
        object.__setattr__(self, "feats", tuple(self.feats))

    def with_feats(self, feats) -> "TableSpec":
        return replace(self, feats=tuple(feats))

    def others(self, target: str) -> list[str]:
        """All features but the target: its predictors."""
        return [f for f in self.feats if f != target]

    @property
    def columns(self) -> list[str]:
        return [self.key, *self.feats] + ([self.label] if self.label else [])
