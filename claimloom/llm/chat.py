"""Chat formatting: a finite-state machine over roles and a declarative template.

DataFrame functions only.  A conversation becomes one text, so a conversation is
also the unit that one row holds; everything else about the operator is per row.

One fold takes a conversation's turns through the template's machine.  The state that a turn leads to
says how the turn is written and whether its text is trained on; whether the template allows
the step says whether the order is valid.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Turns that are folded into one list of states before it is joined to those before it.
FOLD = 512


@dataclass(frozen=True)
class ChatTemplate:
    """What marks turns, which states there are, and which role leads where.

    A turn is ``open + label + sep + text + close``, the label that of the state.  ``labels`` gives each
    state's; a turn in a state without one is written as ``other`` and the role's own name.
    ``transitions`` maps (state, role) to the next state; where there is none the order is invalid, and
    the machine goes on in the state that ``recover`` gives for the role, or in ``strange``.
    Texts of ``loss_states`` are trained on.  A conversation ends well in a state of ``accept``.

    Control strings cannot occur in a text: :func:`escape` replaces the first character of each by
    ``escape`` and a letter that no control string holds.
    """

    open: str = "### "
    sep: str = ": "
    close: str = "</turn>\n"
    labels: dict[str, str] = field(default_factory=lambda: {"system": "System", "user": "User", "assistant": "Assistant"})
    other: str = "="
    escape: str = "\\"
    loss_states: tuple[str, ...] = ("assistant",)
    transitions: dict[tuple[str, str], str] = field(
        default_factory=lambda: {("start", "system"): "system", ("start", "user"): "user", ("system", "user"): "user", ("user", "assistant"): "assistant", ("assistant", "user"): "user"}
    )
    recover: dict[str, str] = field(default_factory=lambda: {"system": "system", "user": "user", "assistant": "assistant"})
    strange: str = "strange"
    accept: tuple[str, ...] = ("user", "assistant")

    def __post_init__(self) -> None:
        controls = (self.open, self.sep, self.close)
        if not all(controls) or not self.other or len(self.escape) != 1:
            raise ValueError("control strings are not empty, and the escape is one character")
        if any(self.escape in c for c in (*controls, self.other, *self.labels.values())):
            raise ValueError("the escape is in no control string")
        if len(set(self.labels.values())) < len(self.labels) or any(self.sep[0] in x or x.startswith(self.other) for x in self.labels.values()) or self.sep[0] in self.other:
            raise ValueError("labels differ, do not begin as others do, and lack the separator's first character")
        for fixed in (self.open, self.sep, self.other, *self.labels.values()):
            if self.close in fixed or any(self.close.startswith(fixed[k:]) for k in range(len(fixed))):
                raise ValueError(f"what closes a turn could begin in {fixed!r}")
        if len(self.tokens()) < len(self._marks()):
            raise ValueError("the control strings hold every letter")
        by_state = {}
        for role, state in [(r, to) for (_, r), to in self.transitions.items()] + list(self.recover.items()):
            if state in self.labels and by_state.setdefault(state, role) != role:
                raise ValueError(f"a state with a label is of one role: {state}")

    def role_of(self, state: str) -> str | None:
        """The role that leads to a state with a label."""
        return next((r for r, to in [(r, to) for (_, r), to in self.transitions.items()] + list(self.recover.items()) if to == state), None)

    def _marks(self) -> list[str]:
        return sorted({self.open[0], self.sep[0], self.close[0]})

    def tokens(self) -> dict[str, str]:
        """For the first character of each control string the letter that stands for it after an escape."""
        held = set(self.open + self.sep + self.close)
        free = [c for c in "abcdefghijklmnopqrstuvwxyz0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ" if c not in held]
        return dict(zip(self._marks(), free, strict=False))


def escape(text: Column, template: ChatTemplate | None = None, label: bool = False) -> Column:
    """The text without any control string, from which :func:`unescape` gives it back, whatever it was.

    The escape is doubled, and the first character of what opens and closes a turn (in a label also of
    the separator) becomes an escape and its letter.  As that character is nowhere left, no control
    string begins in the text, nor in its last characters and what follows.
    """
    t = template or ChatTemplate()
    out = F.replace(text, F.lit(t.escape), F.lit(t.escape * 2))
    for mark, letter in t.tokens().items():
        if label or mark in (t.open[0], t.close[0]):
            out = F.replace(out, F.lit(mark), F.lit(t.escape + letter))
    return out


def unescape(text: Column, template: ChatTemplate | None = None) -> Column:
    """Between doubled escapes, an escape and a letter is the character that the letter stands for."""
    t = template or ChatTemplate()

    def plain(part: Column) -> Column:
        for mark, letter in t.tokens().items():
            part = F.replace(part, F.lit(t.escape + letter), F.lit(mark))
        return part

    return F.array_join(F.transform(F.split(text, _quoted(t.escape * 2), -1), plain), t.escape)


def _quoted(text: str) -> str:
    return "\\Q" + text + "\\E"


def _label(state: Column, role: Column, t: ChatTemplate) -> Column:
    named: Column = F.concat(F.lit(t.other), escape(role, t, label=True))
    for s, label in t.labels.items():
        if t.role_of(s) is not None:
            named = F.when(state == s, F.lit(label)).otherwise(named)
    return named


def _role(label: Column, t: ChatTemplate) -> Column:
    role: Column = unescape(F.substr(label, F.lit(len(t.other) + 1)), t)
    for s, known in t.labels.items():
        if t.role_of(s) is not None:
            role = F.when(label == known, F.lit(t.role_of(s))).otherwise(role)
    return role


def _step(state: Column, role: Column, t: ChatTemplate) -> Column:
    """(state, allowed) after a turn."""
    after: Column = F.lit(t.strange)
    for r, to in t.recover.items():
        after = F.when(role == r, F.lit(to)).otherwise(after)
    step = F.struct(after.alias("state"), F.lit(False).alias("allowed"))
    for (s, r), to in t.transitions.items():
        step = F.when((state == s) & (role == r), F.struct(F.lit(to).alias("state"), F.lit(True).alias("allowed"))).otherwise(step)
    return step


def _run(turns: Column, t: ChatTemplate) -> Column:
    """(state, allowed) of each turn, by one fold over blocks of turns.

    A block's states are gathered first and then joined to those before, so a long conversation's
    list is copied once a block and not once a turn.
    """
    steps = "array<struct<state:string,allowed:boolean>>"

    def over(block: Column, state: Column) -> Column:
        start = F.struct(state.alias("state"), F.array().cast(steps).alias("steps"))
        # an array of one binds the step to a name, so it is evaluated once
        return F.aggregate(block, start, lambda acc, x: F.get(F.transform(F.array(_step(acc["state"], x["role"], t)), lambda s: F.struct(s["state"].alias("state"), F.concat(acc["steps"], F.array(s)).alias("steps"))), F.lit(0)))

    n = F.ceil(F.size(turns) / FOLD).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.slice(turns, k * FOLD + 1, F.lit(FOLD)))
    start = F.struct(F.lit("start").alias("state"), F.array().cast(steps).alias("steps"))
    return F.aggregate(blocks, start, lambda acc, b: F.get(F.transform(F.array(over(b, acc["state"])), lambda r: F.struct(r["state"].alias("state"), F.concat(acc["steps"], r["steps"]).alias("steps"))), F.lit(0)))["steps"]


def format_chats(turns: DataFrame, template: ChatTemplate | None = None, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: ``conv_id, n_turns, segments, formatted, valid, first_invalid``.

    ``segments`` is an array of (text, loss): the pieces of ``formatted`` in order, with
    the loss flag set on the texts of ``loss_states`` alone.  ``valid`` says whether all steps are
    allowed and the last state accepts; ``first_invalid`` is the place (from 0) of the first turn that
    no transition allows, else null.  Invalid conversations are formatted too, so that nothing
    is lost; filter on ``valid`` to drop them.

    Nulls: a null text or role counts as empty; a row with a null conversation is a conversation of
    its own, with a null id, so that very many of them are no long one.  Turns are ordered by turn
    (null first), then role, then text, so ties and repeated rows have one result, and stay.  An
    empty table gives an empty result; other columns are ignored.
    """
    t = template or ChatTemplate()
    rows = turns.select(
        F.col(conv).alias("conv_id"),
        F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).alias("t"),
    )
    convs = rows.where("conv_id IS NOT NULL").groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    convs = convs.unionByName(rows.where("conv_id IS NULL").select("conv_id", F.array("t").alias("turns")))
    convs = convs.withColumn("steps", _run(F.col("turns"), t))

    def piece(c: Column, loss: Column) -> Column:
        return F.struct(c.alias("text"), loss.alias("loss"))

    off = F.lit(False)
    emitted = F.zip_with(
        "turns",
        "steps",
        lambda x, s: F.array(
            piece(F.concat(F.lit(t.open), _label(s["state"], x["role"], t), F.lit(t.sep)), off),
            piece(escape(x["text"], t), s["state"].isin(*t.loss_states)),
            piece(F.lit(t.close), off),
        ),
    )
    bad = F.array_position(F.transform("steps", lambda s: s["allowed"]), False)
    return convs.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.flatten(emitted).alias("segments"),
        F.element_at("steps", -1)["state"].isin(*t.accept).alias("ends"),
        F.when(bad > 0, (bad - 1).cast("int")).alias("first_invalid"),
    ).select(
        "conv_id",
        "n_turns",
        "segments",
        F.array_join(F.transform("segments", lambda x: x["text"]), "").alias("formatted"),
        (F.col("ends") & F.col("first_invalid").isNull()).alias("valid"),
        "first_invalid",
    )


def read_back(formatted: Column, template: ChatTemplate | None = None) -> Column:
    """The turns (role, text) that a formatted text was made of."""
    t = template or ChatTemplate()
    parts = F.split(formatted, _quoted(t.close), -1)
    whole = F.slice(parts, 1, F.size(parts) - 1)

    def turn(part: Column) -> Column:
        # the separator may occur in what opens a turn
        rest = F.substr(part, F.lit(len(t.open) + 1))
        at = F.instr(rest, t.sep)
        return F.struct(_role(F.substr(rest, F.lit(1), at - 1), t).alias("role"), unescape(F.substr(rest, at + len(t.sep)), t).alias("text"))

    return F.transform(whole, turn)


def digests(formatted: DataFrame, template: ChatTemplate | None = None) -> DataFrame:
    """Digest columns of the contract, all read back from ``formatted`` and ``segments``."""
    t = template or ChatTemplate()
    back = formatted.withColumns(
        {
            "_back": read_back(F.col("formatted"), t),
            "_loss": F.array_join(F.transform(F.filter("segments", lambda x: x["loss"]), lambda x: unescape(x["text"], t)), ""),
        }
    )
    return back.select(
        "conv_id",
        F.size("_back").cast("long").alias("n_turns"),
        F.sha2(F.encode(F.array_join(F.transform("_back", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), ""), "UTF-8"), 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"),
        F.sha2(F.encode("_loss", "UTF-8"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


#: The conversation that the contract adds.
EXTRA = "\\### Assistant: </turn> ok"


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    extra = spark.range(1).select(
        F.lit(-7).cast("long").alias("conv_id"), F.explode(F.array(F.struct(F.lit(0).cast("long").alias("turn"), F.lit("user").alias("role")), F.struct(F.lit(1).cast("long").alias("turn"), F.lit("assistant").alias("role")))).alias("r")
    )
    extra = extra.select("conv_id", "r.turn", "r.role", F.lit(EXTRA).alias("text"))
    return digests(format_chats(turns.unionByName(extra)))


OP1_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
f AS (SELECT *, row_number() OVER w AS k, lag(role, 1, 'start') OVER w AS prev,
  2 * length(text) - length(translate(text, '\#<', '')) AS escaped FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(4 + length(role) + 2 + escaped + 8)::BIGINT AS formatted_chars,
  bool_and((prev = 'start' AND role IN ('system', 'user')) OR (prev = 'system' AND role = 'user')
    OR (prev = 'user' AND role = 'assistant') OR (prev = 'assistant' AND role = 'user'))
    AND arg_max(role, k) <> 'system' AS valid
FROM f GROUP BY conv_id
"""
