"""Chat formatting with DataFrame functions only.

A declarative template lists, for each role, literal and text segments with a loss flag each. A finite-state
machine over the roles checks the order of turns. Control strings inside texts are escaped by one more
backslash between `<` and `|`, which reads back exactly.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TEXT, ROLE = "{text}", "{role}"
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"

#: For each role its segments (what, under loss); the entry None serves all other roles.
TEMPLATE: dict[str | None, list[tuple[str, bool]]] = {
    "assistant": [(OPEN, False), (ROLE, False), ("\n", False), (TEXT, True), (CLOSE, False), ("\n", False)],
    None: [(OPEN, False), (ROLE, False), ("\n", False), (TEXT, False), (CLOSE, False), ("\n", False)],
}

#: The machine: state, role, next state. Anything else leads to "invalid"; a conversation may end in any state of ENDS.
TURNS = [
    ("start", "system", "system"),
    ("start", "user", "user"),
    ("system", "user", "user"),
    ("user", "assistant", "assistant"),
    ("assistant", "user", "user"),
]
ENDS = ["assistant"]


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def escape_role(role: Column) -> Column:
    """Roles stand on one line, so their line feeds are escaped as well."""
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def _turn_segments(turn: Column, template: dict) -> Column:
    def filled(parts: list[tuple[str, bool]]) -> Column:
        what = {TEXT: escape(turn["text"]), ROLE: escape_role(turn["role"])}
        return F.array(*(F.struct(what.get(w, F.lit(w)).alias("text"), F.lit(loss).alias("loss")) for w, loss in parts))

    named = [(role, parts) for role, parts in template.items() if role is not None]
    return reduce(lambda other, x: F.when(turn["role"] == x[0], filled(x[1])).otherwise(other), named, filled(template[None]))


def format_chats(conversations: DataFrame, template: dict | None = None) -> DataFrame:
    """One row a conversation: conv_id, n_turns, segments (text, loss), formatted, state, valid.

    Rows are ordered by turn, then role and text, so ties have one order; repeated rows stay. Null roles and
    texts count as empty; rows with a null conv_id make one conversation. `state` is where the machine of
    TURNS ends ("invalid" from the first wrong turn on); every conversation is formatted, valid or not. Turns
    are gathered for each conversation, which is one text in the result. An empty table gives no rows, and
    other columns are ignored.
    """
    template = template or TEMPLATE
    check_template(template)
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    steps = F.create_map(*(F.lit(x) for a, role, b in TURNS for x in (f"{a}\n{role}", b)))
    state = F.aggregate("turns", F.lit("start"), lambda s, t: F.coalesce(F.try_element_at(steps, F.concat(s, F.lit("\n"), t["role"])), F.lit("invalid")))
    segments = F.flatten(F.transform("turns", lambda t: _turn_segments(t, template)))
    out = grouped.select("conv_id", F.size("turns").cast("long").alias("n_turns"), segments.alias("segments"), state.alias("state"))
    text = F.array_join(F.transform("segments", lambda s: s["text"]), "")
    return out.withColumn("formatted", text).withColumn("valid", F.col("state").isin(ENDS))


def _layout(parts: list[tuple[str, bool]]) -> tuple[str, str, str, str, bool]:
    """What stands before the role, between role and text (or before the text), after the text; and if there is a role."""
    names = [w for w, _ in parts]
    if names.count(TEXT) != 1 or names.count(ROLE) > 1 or ROLE in names[names.index(TEXT) :]:
        raise ValueError("a template's entry has one text, and at most one role before it")
    at = names.index(TEXT)
    r = names.index(ROLE) if ROLE in names else -1
    head, middle, tail = "".join(names[: max(r, 0)]), "".join(names[r + 1 : at]), "".join(names[at + 1 :])
    return names[0], head if r >= 0 else "", middle, tail, r >= 0


def check_template(template: dict) -> str:
    """The string that opens every turn; an error if a formatted text could not be read back.

    Escapes protect strings that begin with `<|` and, in roles, line feeds. So all entries open with one and the same such
    string, which stands nowhere else in them; what follows a text begins with another one; what follows a role
    begins with a line feed or `<|`; the entry for all other roles names the role; and the others name theirs at the
    same place, or begin with a control string of their own.
    """
    opens = {_layout(p)[0] for p in template.values()}
    if len(opens) != 1 or not (first := opens.pop()).startswith("<|"):
        raise ValueError("all entries must open with one control string")
    for role, parts in template.items():
        _, _, middle, tail, has_role = _layout(parts)
        if not tail.startswith("<|") or sum(w.count(first) for w, _ in parts) != 1:
            raise ValueError("a text must be closed by a control string, and the opening one stand once")
        if has_role and not middle.startswith(("\n", "<|")):
            raise ValueError("a role must end with a line feed or a control string")
        if role is None and not has_role:
            raise ValueError("the entry for all other roles must name the role")
    if None not in template:
        raise ValueError("there must be an entry for all other roles")
    general = _layout(template[None])[1].removeprefix(first)
    for role, parts in template.items():
        _, head, middle, _, has_role = _layout(parts)
        own = (head if has_role else middle).removeprefix(first)
        apart = own.startswith("<|") and not own.startswith(general or "\n") and not general.startswith(own)
        if role is not None and not apart and not (has_role and own == general):
            raise ValueError("what follows the opening string must tell an entry from the one for all other roles")
    return first


def parse_chats(formatted: Column, template: dict | None = None) -> Column:
    """array<struct<role, text>>: the turns of a text that format_chats made with this template, read back."""
    template = template or TEMPLATE
    first = check_template(template)
    bodies = F.slice(F.split(formatted, re.sub(r"([^\w])", r"\\\1", first)), 2, 2**31 - 2)

    def turn(body: Column) -> Column:
        def taken(role: str | None, parts: list[tuple[str, bool]]) -> Column:
            _, head, middle, tail, has_role = _layout(parts)
            head, middle = head.removeprefix(first), middle if has_role else middle.removeprefix(first)
            if not has_role:
                name, start = F.lit(role), F.lit(len(middle) + 1)
            elif role is not None:
                name, start = F.lit(role), F.length(escape_role(F.lit(role))) + len(head) + len(middle) + 1
            else:
                # the role has no line feed and no control string, so it ends where the middle begins
                end = F.locate(middle, body, len(head) + 1)
                name, start = unescape_role(F.substr(body, F.lit(len(head) + 1), end - 1 - len(head))), end + len(middle)
            text = F.substr(body, start, F.length(body) - start + 1 - len(tail))
            return F.struct(name.alias("role"), unescape(text).alias("text"))

        def opening(role: str, parts: list[tuple[str, bool]]) -> Column:
            _, head, middle, _, has_role = _layout(parts)
            if not has_role:
                return F.lit(middle.removeprefix(first))
            return F.concat(F.lit(head.removeprefix(first)), escape_role(F.lit(role)), F.lit(middle))

        named = [(role, parts) for role, parts in template.items() if role is not None]
        return reduce(lambda other, x: F.when(F.startswith(body, opening(*x)), taken(*x)).otherwise(other), named, taken(None, template[None]))

    return F.transform(bodies, turn)


def loss_text(segments: Column) -> Column:
    """The unescaped text of all segments under the loss, one after the other."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
