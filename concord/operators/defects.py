"""Business rules over the rows of a group: variables, conditions, messages and report fields.

A rule is compiled to aggregates of the two sides and one boolean column. A rule that cannot be
compiled gives one TRANSFORM_ERROR; the others go on.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from concord import errors as E
from concord.functions.numbers import plain
from concord.operators.sides import Side
from concord.rules import Action, DefRule, Trigger

# The forms of a variable, the names of the code column, the functions a condition may call.
AGGREGATE = re.compile(
    r"^(SUM|MIN)\((old|new)\.(\w+)((?:\[\w+=[^\]]+\])*)\)(?:\s+WHERE\s+(\w+)\s*==\s*'([^']+)')?$", re.IGNORECASE
)
COUNT = re.compile(r"^COUNT\((old|new)\)$", re.IGNORECASE)
BRACKET = re.compile(r"\[(\w+)=([^\]]+)\]")
PLACEHOLDER = re.compile(r"\{(\w+)\}")
CODE_COLUMNS = [
    "affectcode", "affect_code", "afcode", "affcode", "affect_cd", "affectcd", "af_code", "aff_code",
]
FUNCTIONS = {
    "Math.abs": "abs", "Math.min": "least", "Math.max": "greatest",
    "Math.round": "round", "Math.floor": "floor", "Math.ceil": "ceil",
}
OPERATORS = {
    "&&": "AND", "||": "OR", "!": "NOT", "===": "=", "==": "=", "!==": "<>", "!=": "<>",
    "<": "<", "<=": "<=", ">": ">", ">=": ">=", "+": "+", "-": "-", "*": "*", "/": "/", "%": "%",
    "(": "(", ")": ")", ",": ",",
}
TOKEN = re.compile(r"\s*(\d+\.?\d*|\.\d+|Math\.\w+|[A-Za-z_]\w*|===|!==|==|!=|<=|>=|&&|\|\||[-+*/%<>!(),])")
LOGICAL = {"&&", "||", "!", "<", "<=", ">", ">=", "!=", "!==", "===", "=="}

# Room for arithmetic on sums without overflow.
VARIABLE = "decimal(30,8)"


class RuleError(ValueError):
    """A rule text the compiler does not understand."""


def tokens_of(text: str) -> list[str]:
    tokens, at = [], 0
    text = text.strip()
    while at < len(text):
        found = TOKEN.match(text, at)
        if not found:
            raise RuleError(f"cannot read {text[at:at + 20]!r} in {text!r}")
        tokens.append(found.group(1))
        at = found.end()
    return tokens


def _operand_end(tokens: list[str], start: int) -> int:
    """Index after the operand that begins at `start`: a value, a call or a bracket."""
    at = start
    while at < len(tokens) and tokens[at] in ("-", "+"):
        at += 1
    if at < len(tokens) and tokens[at] in FUNCTIONS:
        at += 1
    if at < len(tokens) and tokens[at] == "(":
        depth = 0
        for at in range(at, len(tokens)):
            depth += {"(": 1, ")": -1}.get(tokens[at], 0)
            if depth == 0:
                break
    return at + 1


def sql_text(tokens: list[str], columns: dict[str, str]) -> str:
    """Tokens as SQL over the given variable columns; a division by zero becomes null."""
    words, close = [], {}
    for at, token in enumerate(tokens):
        if token in columns:
            words.append(f"`{columns[token]}`")
        elif token in FUNCTIONS:
            words.append(FUNCTIONS[token])
        elif token in OPERATORS:
            words.append(OPERATORS[token])
            if token in ("/", "%"):
                words.append("nullif(")
                end = _operand_end(tokens, at + 1)
                close[end] = close.get(end, 0) + 1
        elif re.match(r"^[\d.]", token):
            words.append(token)
        else:
            raise RuleError(f"unknown name {token!r}")
        words += [", 0)"] * close.pop(at + 1, 0)
    return " ".join(words)


def _parts(tokens: list[str], word: str) -> list[list[str]]:
    """The tokens cut at a word that stands outside brackets."""
    parts: list[list[str]] = [[]]
    depth = 0
    for token in tokens:
        depth += {"(": 1, ")": -1}.get(token, 0)
        if token == word and depth == 0:
            parts.append([])
        else:
            parts[-1].append(token)
    return parts


def _boolean(tokens: list[str], columns: dict[str, str], tolerance: float) -> str:
    """Boolean SQL of tokens with a `==`: alternatives, then conditions, then single comparisons."""
    for word, name in (("||", "OR"), ("&&", "AND")):
        parts = _parts(tokens, word)
        if len(parts) > 1:
            return f" {name} ".join(f"({_boolean(p, columns, tolerance)})" for p in parts)
    if tokens[:1] == ["!"]:
        return f"NOT ({_boolean(tokens[1:], columns, tolerance)})"
    if tokens and tokens[0] == "(" and _operand_end(tokens, 0) == len(tokens):
        return _boolean(tokens[1:-1], columns, tolerance)
    if "==" not in tokens:
        if not LOGICAL & set(tokens):
            raise RuleError(f"no comparison in {' '.join(tokens)!r}")
        return sql_text(tokens, columns)
    at = tokens.index("==")
    left, right = tokens[:at], tokens[at + 1:]
    if not left or not right or LOGICAL & {*left, *right}:
        raise RuleError(f"'==' needs a value on either side in {' '.join(tokens)!r}")
    return (
        f"abs(({sql_text(left, columns)}) - ({sql_text(right, columns)}))"
        f" <= cast('{tolerance}' as decimal(28,8))"
    )


def condition_sql(text: str, columns: dict[str, str], tolerance: float) -> str:
    """Boolean SQL. Each `==` compares its two sides within the tolerance; AND and OR are also words."""
    words = {"AND": "&&", "OR": "||", "NOT": "!"}
    tokens = [words.get(t.upper(), t) if t not in columns else t for t in tokens_of(text)]
    if not tokens:
        raise RuleError("empty condition")
    if "==" in tokens:
        return _boolean(tokens, columns, tolerance)
    sql = sql_text(tokens, columns)
    return sql if LOGICAL & set(tokens) else f"({sql}) <> 0"


def check_sql(spark: SparkSession, sql: str, columns: Iterable[str]) -> None:
    """Raise RuleError where Spark cannot resolve the expression; analyses only, runs nothing."""
    empty = spark.range(0).select(*[F.lit(None).cast(VARIABLE).alias(c) for c in columns], F.lit(1).alias("_one"))
    try:
        empty.select(F.expr(sql)).schema  # noqa: B018
    except (AnalysisException, ParseException) as problem:
        raise RuleError(str(problem).splitlines()[0]) from problem


def aggregate_of(text: str, old: Side, new: Side) -> Column:
    """SUM, MIN or COUNT over the rows of one side; text that is no number counts as zero."""
    text = text.strip()
    counted = COUNT.match(text)
    sides = {"old": old, "new": new}
    if counted:
        return sides[counted.group(1).lower()].rows()
    found = AGGREGATE.match(text)
    if not found:
        raise RuleError(f"expression not parseable: {text!r}")
    kind, side_name, column, brackets, where, value = found.groups()
    side = sides[side_name.lower()]
    tests = [(c, v.strip()) for c, v in BRACKET.findall(brackets or "")]
    if where:
        tests.append((where, value))
    for name in [column, *[c for c, _ in tests]]:
        if name not in side.df.columns:
            raise RuleError(f"column {name!r} not found for {text!r}")
    if kind.upper() == "SUM":
        return side.lenient_sum(column, tests)
    if tests:
        raise RuleError(f"MIN takes no filter: {text!r}")
    return side.lenient_min(column)


def code_column(names: Iterable[str]) -> str | None:
    return next((n for n in names if n.lower() in CODE_COLUMNS), None)


def trigger_of(trigger: Trigger, old: Side, key: Column, known: frozenset[str] | None) -> Column:
    """Whether a rule applies to a group: codes among its old rows, and the start of its key."""
    fires = F.lit(True)
    if trigger.codes():
        column = code_column(old.df.columns)

        def has(code: str) -> Column:
            # A code outside the code list is never found, as in the list's own look-up.
            if column is None or (known is not None and code not in known):
                return F.lit(False)
            return old.any_equal(column, code)

        for code in trigger.must_have_all:
            fires = fires & has(code)
        if trigger.must_have_any:
            some = F.lit(False)
            for code in trigger.must_have_any:
                some = some | has(code)
            fires = fires & some
    for prefix in trigger.groupkey_not_starts_with:
        fires = fires & ~key.startswith(prefix)
    return fires


def interpolate(message: str, variables: dict[str, Column]) -> Column:
    parts, at = [], 0
    for found in PLACEHOLDER.finditer(message):
        parts.append(F.lit(message[at:found.start()]))
        name = found.group(1)
        parts.append(plain(variables[name]) if name in variables else F.lit(found.group(0)))
        at = found.end()
    parts.append(F.lit(message[at:]))
    return F.concat(*parts)


class CompiledAction:
    """One action ready for the joined frame: columns to add, the test that it is broken, and its error."""

    def __init__(self, columns: dict[str, Column], broken: Column, error: Callable[[Column], Column]):
        self.columns, self.broken, self.error = columns, broken, error


def compile_cohesion(
    spark: SparkSession, rule: DefRule, action: Action, place: str, old: Side, new: Side, fires: Column, tolerance: float
) -> CompiledAction:
    names = {name: f"{place}_{name}" for name in action.variables}
    columns = {
        names[name]: aggregate_of(text, old, new).try_cast(VARIABLE) for name, text in action.variables.items()
    }
    sql = condition_sql(action.condition, names, tolerance)
    check_sql(spark, sql, columns)
    variables = {name: F.col(f"`{column}`") for name, column in names.items()}
    fields = {}
    for field, text in action.report_fields.items():
        try:
            value = aggregate_of(text, old, new)
        except RuleError:
            try:
                expression = sql_text(tokens_of(text), names)
                check_sql(spark, expression, columns)
                value = F.expr(expression)
            except RuleError:
                value = F.lit(None)
        fields[field] = value
    report = None
    if fields:
        report = F.create_map(
            *[x for f, v in fields.items() for x in (F.lit(f), plain(v.cast(VARIABLE)))]
        )

    def error(key: Column) -> Column:
        return E.error(
            E.DEFECT_VIOLATION, def_id=rule.def_id, group_key=key,
            message=interpolate(action.error_message, variables), report_fields=report,
        )

    return CompiledAction(columns, fires & ~F.coalesce(F.expr(sql), F.lit(False)), error)


def value_check_parts(rule: DefRule, action: Action, old: Side, new: Side) -> tuple[str, str, str, str]:
    """new column, old column, permitted old value, failing pattern of a FIELD_VALUE_CHECK."""
    new_col, pattern = action.variables.get("new_col", ""), action.variables.get("fail_if_new_matches", "")
    old_col, permitted = action.variables.get("old_col", ""), action.variables.get("skip_if_old_equals", "")
    if not new_col or not pattern:
        raise RuleError(f"{rule.def_id}: a value check needs new_col and fail_if_new_matches")
    try:
        re.compile(pattern)
    except re.error as problem:
        raise RuleError(f"{rule.def_id}: invalid pattern {pattern!r}") from problem
    if new_col not in new.df.columns or (old_col and old_col not in old.df.columns):
        raise RuleError(f"{rule.def_id}: column not found")
    return new_col, old_col, permitted, pattern


def compile_value_check(
    rule: DefRule, action: Action, old: Side, new: Side, fires: Column
) -> CompiledAction:
    """More failing new values than old rows that permit one."""
    new_col, old_col, permitted, pattern = value_check_parts(rule, action, old, new)
    bad = new.count_matching(new_col, f"(?i){pattern}")
    allowed = old.count_equal(old_col, permitted) if permitted and old_col else F.lit(0)

    def error(key: Column) -> Column:
        return E.error(
            E.DEFECT_VIOLATION, def_id=rule.def_id, group_key=key,
            old_column=old_col or None, new_column=new_col, message=F.lit(action.error_message),
        )

    return CompiledAction({}, fires & (bad - allowed > 0), error)


