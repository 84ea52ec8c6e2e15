"""Finds licence notices: units and windows of text against templates by the Dice coefficient of their word bigrams.

Units are the lines of a text and, where it has several, the whole text. A unit is lower-cased and cut into words of
letters and digits; its bigrams are the different pairs of neighbouring words (one word alone is its own bigram). Two
sets of a and b bigrams with c in common have the coefficient 2c / (a + b), which is at most 2 min(a, b) / (a + b); so
only templates between t / (2 - t) and (2 - t) / t times the unit's size are compared.

Windows are stretches of the words of the whole text, so they find what is wrapped over lines, stands within a line of
prose, or is a licence body within a longer text. Those of a template of n bigrams in a row begin at one of its bigrams
(or are the last n of the text) and have n bigrams, or up to (2 - t) / t times as many and then end at one of its own.
A window has no fewer than n (all, in a shorter text), or the common beginning of notices of other versions would do.
Windows are taken by coefficient, each where none before it stands. A unit gives way to a higher coefficient of another
licence in its place; a window counts where no unit left names its licence or has its coefficient.
Bodies and templates of one word: the former have windows only, the latter units only.

A match misses few bigrams of a template, so of some chosen rare ones (`anchors`) at least one is in it. Only texts with
a word of these are cut into lines and windows. All of it is DataFrame functions on the row itself: no shuffle.

Null and empty texts have no units and no licence. Repeated rows and null ids come back as they are; extra columns are
not read. Of equal coefficients the first id in order wins. An empty table gives an empty table.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.llm.common import query, table
from concord.llm.license_texts import BODIES

LEAST = 0.8
# Short notices by the usual licence identifiers.
TEMPLATES = {
    "AGPL-3.0": "Licensed under the GNU Affero General Public License, version 3.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-2-Clause": "Released under the BSD 2-Clause License.",
    "BSD-3-Clause": "Released under the BSD 3-Clause License.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-NC-SA-4.0": "Licensed under CC BY-NC-SA 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "Dedicated to the public domain under CC0 1.0.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "ISC": "Released under the ISC License.",
    "LGPL-2.1": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "Released into the public domain under the Unlicense.",
}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Fixed value: what stands between words.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# Words that do not tell a licence; they decide about speed only.
COMMON = set("a all and any as at be by for from if in into is it its may not of on one or other out see that the this to under use was were which with without you your".split())
PLACE = "dice double, order int, license string, first int, last int"


def template_words(text: str) -> list[str]:
    return [w for w in re.split(BETWEEN, text.translate(str.maketrans(UPPER, LOWER))) if w]


def template_bigrams(text: str) -> list[str]:
    words = template_words(text)
    return sorted({" ".join(words[k:k + 2]) for k in range(max(len(words) - 1, 1))})


def bounds(size: int, least: float) -> tuple[float, float]:
    """Sizes of sets that can have a coefficient of `least` with a set of `size`."""
    return size * least / (2 - least), size * (2 - least) / least


def anchors(own: list[str], least: float) -> dict[str, str]:
    """Rare bigrams of a template, one of which is in every match, each with its rarest word.

    With c bigrams of b in common the other set has c at least, so c >= b t / (2 - t).
    """
    missing = len(own) - math.ceil(bounds(len(own), least)[0] - 1e-9)
    rare = lambda word: (word not in COMMON, len(word), word)
    best = sorted(own, key=lambda g: (max(map(rare, g.split(" "))), g), reverse=True)[:missing + 1]
    return {g: max(g.split(" "), key=rare) for g in best}


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """`then` of a value that is computed once."""
    return F.transform(F.array(value), then)[0]


def _words(unit: Column) -> Column:
    return F.array_remove(F.split(unit, BETWEEN), "")


def _pairs(words: Column) -> Column:
    return F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda a, b: F.concat_ws(" ", a, b))


def _bigrams(words: Column) -> Column:
    return F.when(F.size(words) > 1, F.array_distinct(_pairs(words))).otherwise(words)


def _best(bigrams: Column, templates: dict[str, list[str]], orders: dict[str, int], least: float) -> Column:
    """The best template of a set of bigrams, as (coefficient, order, id); null where none can reach `least`."""
    found = []
    for name, own in sorted(templates.items()):
        low, high = bounds(len(own), least)
        common = F.size(F.array_intersect(bigrams, F.array(*map(F.lit, own))))
        dice = 2.0 * common / (F.size(bigrams) + len(own))
        found.append(F.when(F.size(bigrams).between(low, high), F.struct(dice.alias("dice"), F.lit(-orders[name]).alias("order"), F.lit(name).alias("license"))))
    best = F.array_max(F.array(*found))
    return F.when(best["dice"] >= least, best)


def _units(words: Column, templates: dict[str, list[str]], orders: dict[str, int], least: float) -> Column:
    """The units that are notices, as places; `words` are those of each unit, the whole text last."""
    limits = [b for own in templates.values() for b in bounds(len(own), least)]
    # A set of bigrams is at most as large as its words less one, so short units end here; long ones after their bigrams.
    sized = lambda w: F.when(F.size(w) >= max(min(limits), 1), _let(_bigrams(w), lambda b: F.when(F.size(b).between(min(limits), max(limits)), _best(b, templates, orders, least))))
    found = F.filter(F.transform(words, lambda w, i: F.struct(sized(w).alias("best"), i.alias("unit"))), lambda u: u["best"].isNotNull())
    whole = lambda u: (F.size(words) > 1) & (u["unit"] == F.size(words) - 1)
    first = lambda u: F.when(whole(u), 0).otherwise(F.aggregate(F.slice(words, 1, u["unit"]), F.lit(0), lambda n, w: n + F.size(w)))
    return F.transform(found, lambda u: _let(first(u), lambda k: _place(
        u["best"]["dice"], u["best"]["order"], u["best"]["license"], k, k + F.greatest(F.size(F.get(words, u["unit"])) - 2, F.lit(0)))))


def _place(dice: Column, order: Column, name: Column, first: Column, last: Column) -> Column:
    """A match from the bigram `first` of the text to `last`."""
    return F.struct(dice.alias("dice"), order.alias("order"), name.alias("license"), first.alias("first"), last.alias("last"))


def _touch(a: Column, b: Column) -> Column:
    return (a["first"] <= b["last"]) & (b["first"] <= a["last"])


def _none() -> Column:
    return F.expr(f"cast(array() as array<struct<{PLACE.replace(' ', ':').replace(',:', ',')}>>)")


def _table(templates: list[tuple[str, list[str]]], orders: dict[str, int], least: float) -> tuple[Column, list[str], int]:
    """The templates as an array of rows (one literal once folded), their anchors, and the longest window."""
    rows, all_rare = [], set()
    for name, words in templates:
        own = sorted({" ".join(words[k:k + 2]) for k in range(len(words) - 1)})
        rare = sorted(anchors(own, least))
        all_rare.update(rare)
        rows.append({"license": name, "order": -orders[name], "own": own, "rare": rare, "least_common": math.ceil(bounds(len(own), least)[0] - 1e-9),
                     "shortest": len(words) - 1, "longest": math.floor(bounds(len(words) - 1, least)[1] + 1e-9)})
    kind = "array<struct<license string, order int, own array<string>, rare array<string>, least_common int, shortest int, longest int>>"
    return F.from_json(F.lit(json.dumps(rows)), kind), sorted(all_rare), max((r["longest"] for r in rows), default=0)


def _windows(t: Column, pairs: Column, spots: Column, back: Column, least: float) -> Column:
    """The windows of a template that are matches. `back`: how far behind a bigram the same one stands; `spots`: anchors."""
    number = F.size(pairs)
    full = F.least(t["shortest"], number)

    def of_start(k: Column, hits: Column) -> Column:
        # size and common of the window to each bigram, and those windows that may end there
        def step(seen: Column, e: Column) -> Column:
            new = F.get(back, e) > e - k
            return F.struct((seen["size"] + new.cast("int")).alias("size"), (seen["common"] + (new & F.get(hits, e)).cast("int")).alias("common"))

        def found(seen: Column, e: Column) -> Column:
            ends = (e - k + 1 == full) | ((e - k + 1 > full) & F.get(hits, e))
            place = lambda dice: F.when(ends & (dice >= least), F.concat(seen["found"], F.array(_place(dice, t["order"], t["license"], k, e)))).otherwise(seen["found"])
            return _let(step(seen["at"], e), lambda at: F.struct(at.alias("at"), _let(2.0 * at["common"] / (at["size"] + F.size(t["own"])), place).alias("found")))

        none = F.struct(F.struct(F.lit(0).alias("size"), F.lit(0).alias("common")).alias("at"), _none().alias("found"))
        return F.aggregate(F.sequence(k, F.least(k + t["longest"], number) - 1), none, found, lambda seen: seen["found"])

    def starts(near: Column, hits: Column) -> Column:
        last = F.greatest(number - t["shortest"], F.lit(0))
        within = F.filter(F.sequence(F.lit(0), last), lambda k: ((k == last) | F.get(hits, k)) & F.exists(near, lambda s: (s >= k) & (s < k + t["longest"])))
        common = lambda k: F.size(F.array_distinct(F.filter(F.slice(pairs, k + 1, t["longest"]), lambda g, i: F.get(hits, k + i))))
        return F.filter(within, lambda k: common(k) >= t["least_common"])

    near = F.filter(spots, lambda s: F.array_contains(t["rare"], F.get(pairs, s)))
    hits = lambda near: F.transform(pairs, lambda g, k: F.exists(near, lambda s: F.abs(s - k) < t["longest"]) & F.array_contains(t["own"], g))
    return _let(near, lambda n: F.when(F.size(n) > 0, _let(hits(n), lambda h: F.flatten(F.transform(starts(n, h), lambda k: of_start(k, h))))).otherwise(_none()))


def _places(pairs: Column, templates: list[tuple[str, list[str]]], orders: dict[str, int], least: float) -> Column:
    """The best windows that do not touch each other."""
    rows, rare, far = _table([(name, words) for name, words in templates if len(words) > 1], orders, least)
    spots = F.filter(F.transform(pairs, lambda g, k: F.when(g.isin(rare), k)), lambda k: k.isNotNull())

    def back(spots: Column) -> Column:
        def behind(g: Column, k: Column) -> Column:
            before = F.reverse(F.slice(pairs, F.greatest(k - far, F.lit(0)) + 1, F.least(k, F.lit(far))))
            return _let(F.array_position(before, g).cast("int"), lambda p: F.when(p > 0, p).otherwise(far + 1))

        return F.transform(pairs, lambda g, k: F.when(F.exists(spots, lambda s: F.abs(s - k) <= far), behind(g, k)).otherwise(far + 1))

    found = lambda spots: _let(back(spots), lambda b: F.flatten(F.transform(rows, lambda t: _windows(t, pairs, spots, b, least))))
    ranked = lambda all_: F.array_sort(F.transform(all_, lambda w: F.struct((-w["dice"]).alias("a"), (-w["order"]).alias("b"), w["first"].alias("c"), w["last"].alias("d"), w.alias("w"))))
    apart = lambda kept, w: F.when(F.exists(kept, lambda o: _touch(o, w["w"])), kept).otherwise(F.concat(kept, F.array(w["w"])))
    return _let(spots, lambda s: F.when(F.size(s) > 0, F.aggregate(ranked(found(s)), _none(), apart)).otherwise(_none()))


def _settled(units: Column, windows: Column) -> Column:
    better = lambda u, o: (o["dice"] > u["dice"]) & (o["license"] != u["license"]) & _touch(u, o)
    left = F.filter(units, lambda u: ~F.exists(units, lambda o: better(u, o)) & ~F.exists(windows, lambda o: better(u, o)))
    named = lambda w, u: _touch(w, u) & ((u["license"] == w["license"]) | (u["dice"] >= w["dice"]))
    return _let(left, lambda kept: F.concat(kept, F.filter(windows, lambda w: ~F.exists(kept, lambda u: named(w, u)))))


def license_scan(documents: DataFrame, templates: dict[str, str] | None = None, least: float = LEAST, bodies: list[tuple[str, str]] | None = None) -> DataFrame:
    """doc_id, n_units, matches (coefficient, order, id of each unit or window that is a notice).

    `bodies` are more texts, several of an id if need be; those of `license_texts` where no templates are given.
    """
    bodies = bodies if bodies is not None else [] if templates else BODIES
    sets = {name: template_bigrams(text) for name, text in (templates or TEMPLATES).items()}
    sequences = [(name, template_words(text)) for name, text in [*(templates or TEMPLATES).items(), *bodies]]
    orders = {name: k for k, name in enumerate(sorted({name for name, _ in sequences}))}
    telling = sorted({w for own in [*sets.values(), *(template_bigrams(text) for _, text in bodies)] for w in anchors(own, least).values()})
    text = F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER)
    lines = F.filter(F.split(text, "\n"), lambda u: F.length(u) > 0)
    units = F.when(F.size(lines) > 1, F.concat(lines, F.array(text))).otherwise(lines)
    found = _let(F.transform(units, _words), lambda per: _let(_pairs(F.element_at(per, -1)), lambda pairs: _let(
        _units(per, sets, orders, least), lambda u: _let(_places(pairs, sequences, orders, least), lambda w: _settled(u, w)))))
    places = F.when(F.exists(_words(text), lambda w: w.isin(telling)), found).otherwise(_none())
    n_units = F.when(F.size(lines) > 1, F.size(lines) + 1).otherwise(F.size(lines))
    matches = F.transform(places, lambda m: F.struct(m["dice"].alias("dice"), m["order"].alias("order"), m["license"].alias("license")))
    return documents.select("doc_id", n_units.cast("long").alias("n_units"), matches.alias("matches"))


def _oracle() -> str:
    rows = ", ".join("('{}', '{}')".format(name, g) for name, text in sorted(TEMPLATES.items()) for g in template_bigrams(text))
    # Larger sets of bigrams cannot reach the coefficient with any template.
    longest = max(math.floor(bounds(len(template_bigrams(text)), LEAST)[1] + 1e-9) for text in TEMPLATES.values())
    return rf"""
with t(license, gram) as (values {rows}),
tn as (select license, count(*) as size from t group by license),
d as (select doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') as text from documents),
l as (select doc_id, text, list_filter(string_split(text, chr(10)), lambda u: length(u) > 0) as lines from d),
u as (select doc_id, case when len(lines) > 1 then list_append(lines, text) else lines end as units from l),
e as (select doc_id, unnest(range(len(units))) as unit, unnest(list_transform(units, lambda u: list_filter(string_split_regex(u, '{BETWEEN}'), lambda w: w <> ''))) as w from u),
g as (select doc_id, unit, list_distinct(case when len(w) > 1 then list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) else w end) as grams from e),
x as (select doc_id, unit, len(grams) as size, unnest(grams) as gram from g where len(grams) <= {longest}),
c as (select x.doc_id, x.unit, t.license, 2.0::double * count(*) / (any_value(x.size) + any_value(tn.size)) as dice
      from x join t using (gram) join tn using (license) group by x.doc_id, x.unit, t.license),
m as (select doc_id, unit, license, dice from c where dice >= {LEAST} qualify row_number() over (partition by doc_id, unit order by dice desc, license) = 1),
s as (select doc_id, count(*) as n_matches, string_agg(distinct license, ',' order by license) as licenses, max(dice) as best_dice from m group by doc_id)
select u.doc_id, cast(len(units) as bigint) as n_units, coalesce(n_matches, 0) as n_matches, coalesce(licenses, '') as licenses, best_dice
from u left join s using (doc_id)
"""


@query("op6_license_scan", _oracle())
def op6_license_scan(spark, folder):
    found = license_scan(table(spark, folder, "documents"))
    names = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["license"])))
    return found.select("doc_id", "n_units", F.size("matches").cast("long").alias("n_matches"), F.concat_ws(",", names).alias("licenses"),
                        F.array_max(F.transform("matches", lambda m: m["dice"])).alias("best_dice"))
