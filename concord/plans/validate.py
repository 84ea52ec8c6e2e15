"""Entry point: the validator of a rule's table type."""

from __future__ import annotations

from collections.abc import Callable

from concord.plans.containment import validate_split
from concord.plans.header import validate_header
from concord.plans.master import validate_master
from concord.plans.multiple import validate_multiple, validate_union
from concord.plans.outcome import Outcome
from concord.plans.transaction import validate_transaction
from concord.rules import Rule
from concord.sources.tables import Resolver

VALIDATORS: dict[str, Callable[[Rule, Resolver], Outcome]] = {
    "MASTER": validate_master,
    "ASSOCIATE": validate_master,
    "TRANSACTION": validate_transaction,
    "MULTIPLE": validate_multiple,
    "UNION": validate_union,
    "SPLIT": validate_split,
    "HEADER": validate_header,
}


def validate(rule: Rule, find: Resolver) -> Outcome:
    return VALIDATORS[rule.table_type](rule, find)
