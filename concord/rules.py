"""Rules as plain dataclasses, read from dictionaries or YAML files."""

from __future__ import annotations

import os
from dataclasses import dataclass, field
from typing import Any

# Table types, and the columns a filtered sum may test.
TABLE_TYPES = ("MASTER", "ASSOCIATE", "SPLIT", "TRANSACTION", "MULTIPLE", "UNION", "HEADER")
FILTER_COLUMNS = {
    "affectcode_in": "affectcode",
    "debitcredit": "debitcredit",
    "loantranshostcode_in": "loantranshostcode",
    "loantranshostcode_not_in": "loantranshostcode",
}


@dataclass(frozen=True)
class Exact:
    old: str
    new: str
    transform: str | None = None
    source: str | None = None
    target: str | None = None


@dataclass(frozen=True)
class Subset:
    old: str
    new: str


@dataclass(frozen=True)
class Split:
    old: str
    new_cols: tuple[str, ...]
    formula: str = "SUM"


@dataclass(frozen=True)
class Transformed:
    old: str
    new: str
    transform: str = "NONE"
    source: str | None = None
    target: str | None = None


@dataclass(frozen=True)
class Concat:
    old_cols: tuple[str, ...]
    new: str
    separator: str = ""
    source: str | None = None
    target: str | None = None


@dataclass(frozen=True)
class Formula:
    old_cols: tuple[str, ...]
    formula: str
    new: str


@dataclass(frozen=True)
class RowFilter:
    """AND of the given tests; an empty one lets every row through."""

    affectcode_in: tuple[str, ...] = ()
    debitcredit: str | None = None
    loantranshostcode_in: tuple[str, ...] = ()
    loantranshostcode_not_in: tuple[str, ...] = ()

    def columns(self) -> list[str]:
        used = [column for name, column in FILTER_COLUMNS.items() if getattr(self, name)]
        return list(dict.fromkeys(used))

    def label(self) -> str:
        parts = []
        if self.affectcode_in:
            parts.append(f"affectcode in [{','.join(self.affectcode_in)}]")
        if self.debitcredit:
            parts.append(f"dc={self.debitcredit}")
        return ",".join(parts)


@dataclass(frozen=True)
class FilteredSum:
    old: str
    new: str
    old_filter: RowFilter = RowFilter()
    new_filter: RowFilter | None = None
    skip_if_old_empty: bool = False


@dataclass(frozen=True)
class Pivot:
    pivot_value: str
    value_col: str
    new_col: str


@dataclass(frozen=True)
class Mappings:
    exact: tuple[Exact, ...] = ()
    split: tuple[Split, ...] = ()
    transformed: tuple[Transformed, ...] = ()
    concat: tuple[Concat, ...] = ()
    formula: tuple[Formula, ...] = ()
    filtered_sum: tuple[FilteredSum, ...] = ()
    subset: tuple[Subset, ...] = ()
    pivot: tuple[Pivot, ...] = ()

    def old_columns(self) -> list[str]:
        """Source columns the mappings compare."""
        names = [m.old for m in (*self.exact, *self.split, *self.transformed, *self.filtered_sum, *self.subset)]
        names += [c for m in (*self.concat, *self.formula) for c in m.old_cols]
        names += [m.value_col for m in self.pivot]
        return list(dict.fromkeys(names))

    def new_columns(self) -> list[str]:
        names = [m.new for m in (*self.exact, *self.transformed, *self.concat, *self.formula)]
        names += [m.new for m in (*self.filtered_sum, *self.subset)]
        names += [c for m in self.split for c in m.new_cols]
        names += [m.new_col for m in self.pivot]
        return list(dict.fromkeys(names))

    def filter_columns(self) -> tuple[list[str], list[str]]:
        old = [c for m in self.filtered_sum for c in m.old_filter.columns()]
        new = [c for m in self.filtered_sum if m.new_filter for c in m.new_filter.columns()]
        return list(dict.fromkeys(old)), list(dict.fromkeys(new))

    def without(self, old_missing: set[str], new_missing: set[str]) -> Mappings:
        """The mappings that touch none of the missing columns."""
        kept: dict[str, tuple] = {}
        for name in self.__dataclass_fields__:
            kept[name] = tuple(
                m for m in getattr(self, name)
                if not _old_side(m) & old_missing and not _new_side(m) & new_missing
            )
        return Mappings(**kept)

    def empty(self) -> bool:
        return not any(getattr(self, name) for name in self.__dataclass_fields__)


def _old_side(mapping: Any) -> set[str]:
    if isinstance(mapping, FilteredSum):
        return {mapping.old, *mapping.old_filter.columns()}
    if isinstance(mapping, Pivot):
        return {mapping.value_col}
    return set(mapping.old_cols) if hasattr(mapping, "old_cols") else {mapping.old}


def _new_side(mapping: Any) -> set[str]:
    if isinstance(mapping, FilteredSum):
        return {mapping.new, *(mapping.new_filter.columns() if mapping.new_filter else [])}
    if isinstance(mapping, Pivot):
        return {mapping.new_col}
    return set(mapping.new_cols) if hasattr(mapping, "new_cols") else {mapping.new}


@dataclass(frozen=True)
class AccountMapping:
    table: str
    lookup_col: str
    result_col: str


@dataclass(frozen=True)
class CompositeKey:
    old_col: str
    new_col: str
    mapping: AccountMapping | None = None


@dataclass(frozen=True)
class Grouping:
    old_key: str
    new_key: str
    transform_key: str | None = None
    source_key_aliases: dict[str, str] = field(default_factory=dict)
    row_fingerprint: tuple[tuple[str, str, bool], ...] = ()
    composite_key: CompositeKey | None = None


@dataclass(frozen=True)
class PivotConfig:
    old_identity: str
    new_identity: str
    pivot_key: str


@dataclass(frozen=True)
class Trigger:
    must_have_all: tuple[str, ...] = ()
    must_have_any: tuple[str, ...] = ()
    groupkey_not_starts_with: tuple[str, ...] = ()

    def codes(self) -> set[str]:
        return {*self.must_have_all, *self.must_have_any}


@dataclass(frozen=True)
class Action:
    check_type: str
    variables: dict[str, str] = field(default_factory=dict)
    condition: str = ""
    error_message: str = ""
    trigger: Trigger = Trigger()
    report_fields: dict[str, str] = field(default_factory=dict)
    step: str = ""


@dataclass(frozen=True)
class DefRule:
    def_id: str
    actions: tuple[Action, ...]
    trigger: Trigger = Trigger()


@dataclass(frozen=True)
class Rule:
    name: str
    table_type: str
    source: str
    target: str
    mappings: Mappings
    old_anchor: str | None = None
    new_anchor: str | None = None
    grouping: Grouping | None = None
    pivot: PivotConfig | None = None
    source_filter: str | None = None
    tolerance: float = 0
    # Unset means 0 for the comparison and 0.01 for the cross-check of totals.
    tolerance_set: bool = False
    skip_aggregate_sum_check: bool = False
    defs: tuple[DefRule, ...] = ()
    known_codes: frozenset[str] | None = None
    report_extra_groups: bool | None = None
    blank_as_zero: bool = False

    def sources(self) -> list[str]:
        return [s.strip() for s in self.source.split(",")]

    def targets(self) -> list[str]:
        return [t.strip() for t in self.target.split(",")]

    def extras_wanted(self) -> bool:
        """Target rows outside a filter belong to other rules, so extras are reported only without one."""
        return self.source_filter is None if self.report_extra_groups is None else self.report_extra_groups


def _trigger(raw: dict | None) -> Trigger:
    raw = raw or {}
    return Trigger(
        tuple(map(str, raw.get("must_have_all") or ())),
        tuple(map(str, raw.get("must_have_any") or ())),
        tuple(map(str, raw.get("groupkey_not_starts_with") or ())),
    )


def _filter(raw: dict | None) -> RowFilter:
    raw = raw or {}
    return RowFilter(
        tuple(map(str, raw.get("affectcode_in") or ())),
        raw.get("debitcredit"),
        tuple(map(str, raw.get("loantranshostcode_in") or ())),
        tuple(map(str, raw.get("loantranshostcode_not_in") or ())),
    )


def mappings_from(raw: dict) -> Mappings:
    def each(name: str) -> list[dict]:
        return raw.get(name) or []

    return Mappings(
        exact=tuple(
            Exact(m["old"], m["new"], m.get("transform_rule"), m.get("src_table"), m.get("tgt_table"))
            for m in each("exact_matches")
        ),
        split=tuple(Split(m["old"], tuple(m["new_cols"]), m["formula"]) for m in each("split_matches")),
        transformed=tuple(
            Transformed(m["old"], m["new"], m.get("transform_rule", "NONE"), m.get("src_table"), m.get("tgt_table"))
            for m in each("transformed_matches")
        ),
        concat=tuple(
            Concat(tuple(m["old_cols"]), m["new"], m.get("separator") or "", m.get("src_table"), m.get("tgt_table"))
            for m in each("concat_matches")
        ),
        formula=tuple(Formula(tuple(m["old_cols"]), m["formula"], m["new"]) for m in each("formula_matches")),
        filtered_sum=tuple(
            FilteredSum(
                m["old"], m["new"], _filter(m.get("old_filter")),
                _filter(m["new_filter"]) if m.get("new_filter") else None,
                bool(m.get("skip_if_old_empty")),
            )
            for m in each("filtered_sum_matches")
        ),
        subset=tuple(Subset(m["old"], m["new"]) for m in each("subset_matches")),
        pivot=tuple(Pivot(str(m["pivot_key_value"]), m["value_col"], m["new_col"]) for m in each("pivot_matches")),
    )


def def_from(raw: dict, def_id: str | None = None) -> DefRule:
    return DefRule(
        def_id or raw["def_id"],
        tuple(
            Action(
                check_type=a["check_type"],
                variables={k: str(v) for k, v in (a.get("variables") or {}).items()},
                condition=str(a.get("condition") or ""),
                error_message=str(a.get("error_message") or "").strip(),
                trigger=_trigger(a.get("trigger_condition")),
                report_fields={k: str(v) for k, v in (a.get("report_fields") or {}).items()},
                step=str(a.get("step") or ""),
            )
            for a in raw.get("actions") or []
        ),
        _trigger(raw.get("trigger_condition")),
    )


def rule_from(name: str, raw: dict, defs: tuple[DefRule, ...] = (), known_codes=None) -> Rule:
    """Rule from a parsed rule file."""
    info = raw["table_info"]
    if info["table_type"] not in TABLE_TYPES:
        raise ValueError(f"unknown table type {info['table_type']!r}")
    anchor = raw.get("anchor_key") or {}
    grouping = None
    if raw.get("transaction_grouping"):
        g = raw["transaction_grouping"]
        composite = None
        if g.get("composite_key"):
            c = g["composite_key"]
            lookup = c.get("account_mapping")
            composite = CompositeKey(
                c["old_col"], c["new_col"],
                AccountMapping(lookup["table"], lookup["lookup_col"], lookup["result_col"]) if lookup else None,
            )
        grouping = Grouping(
            g["keys"]["old"], g["keys"]["new"], g.get("transform_key"),
            dict(g.get("source_key_aliases") or {}),
            tuple((f["old"], f["new"], f.get("transform") == "YEAR_ONLY") for f in g.get("row_fingerprint") or ()),
            composite,
        )
    pivot = None
    if raw.get("pivot_config"):
        p = raw["pivot_config"]
        pivot = PivotConfig(p["identity_key"]["old"], p["identity_key"]["new"], p["pivot_key"])
    tolerance = (raw.get("defaults") or {}).get("tolerance")
    return Rule(
        name=name,
        table_type=info["table_type"],
        source=info["source"],
        target=info["target"],
        mappings=mappings_from(raw.get("schema_mappings") or {}),
        old_anchor=anchor.get("old"),
        new_anchor=anchor.get("new"),
        grouping=grouping,
        pivot=pivot,
        source_filter=info.get("source_filter"),
        tolerance=tolerance or 0,
        tolerance_set=tolerance is not None,
        skip_aggregate_sum_check=bool(raw.get("skip_aggregate_sum_check")),
        defs=defs,
        known_codes=known_codes,
    )


def load_defs(folders: list[str], wanted: list[str] | None = None) -> tuple[DefRule, ...]:
    """Business rules from folders in order of priority: an id found earlier hides a later one."""
    import yaml

    found: dict[str, DefRule] = {}
    for folder in folders:
        if not os.path.isdir(folder):
            continue
        for file in sorted(os.listdir(folder)):
            def_id, extension = os.path.splitext(file)
            if extension not in (".yaml", ".yml") or def_id in found or (wanted and def_id not in wanted):
                continue
            with open(os.path.join(folder, file), encoding="utf-8") as handle:
                found[def_id] = def_from(yaml.safe_load(handle), def_id)
    return tuple(found.values())


def load_rule(root: str, path: str, known_codes=None, vali: list[str] | None = None, defs: list[str] | None = None) -> Rule:
    """Rule file `<root>/<path>/common.yaml` with its own and the global business rules."""
    import yaml

    folder = os.path.join(root, path)
    with open(os.path.join(folder, "common.yaml"), encoding="utf-8") as handle:
        raw = yaml.safe_load(handle)
    rules = load_defs([os.path.join(folder, "vali"), os.path.join(root, "vali")], vali)
    rules += load_defs([os.path.join(folder, "def"), os.path.join(root, "global", "defs")], defs)
    return rule_from(os.path.basename(path), raw, rules, known_codes)
