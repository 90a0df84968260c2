"""Conversations as one text each, proven by reading it back: SQL expressions only.

The grammar::

    conversation = turn*
    turn         = "<s>" body "</s>"                          (assistant)
                 | "[INST]" role newline body "[/INST]"       (any other role)

A body holds none of the four marks. Each turn is rendered as it is and read back; where the turn that
comes back differs from the source, one mark after another is escaped in the body until they are
identical: a backslash goes in after the mark's first character, one more where there are some already,
and reading takes one away. Marks begin with a character that occurs nowhere else in them, so none can form
across the edge of a body, and turns that can be read back one by one can be read back in a row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ASSISTANT = "assistant"
OPEN, CLOSE = "<s>", "</s>"
OTHER_OPEN, OTHER_CLOSE = "[INST]", "[/INST]"

# Expressions are SQL text, with patterns as raw literals; columns made on the way begin with an underscore.
# A pattern begins with the one or two characters it can begin with, which are quick to look for.
_MARK = r"r'[<\[](?:(?<=<)/?s>|(?<=\[)/?INST\])'"
_CLOSING = r"r'[<\[]/(?:(?<=<.)s>|(?<=\[.)INST\])'"
_ESCAPED = r"r'\\(?:(?<=<.)(?=\\*/?s>)|(?<=\[.)(?=\\*/?INST\]))'"
#: What begins each mark, escaped or not, and what takes its place.
_ESCAPES = (
    (r"r'<(?=\\*s>)'", r"r'<\\'"),
    (r"r'<(?=\\*/s>)'", r"r'<\\'"),
    (r"r'\[(?=\\*INST\])'", r"r'[\\'"),
    (r"r'\[(?=\\*/INST\])'", r"r'[\\'"),
)
#: A role of letters, digits and ``_.-`` stands as it is; any other in hexadecimal after ``=``.
_ROLE = r"IF(role RLIKE r'\A[A-Za-z0-9_.-]+\z', role, '=' || hex(encode(role, 'UTF-8')))"
_RENDERED = rf"IF(role = '{ASSISTANT}', '{OPEN}' || _body || '{CLOSE}', '{OTHER_OPEN}' || {_ROLE} || '\n' || _body || '{OTHER_CLOSE}')"


def _unescaped(body: str) -> str:
    return rf"IF(contains({body}, '\\'), regexp_replace({body}, {_ESCAPED}, ''), {body})"


def _cut(df: DataFrame, text: str) -> DataFrame:
    """Add ``_cuts``: the turns without their closing marks, as (loss, inner); null where the text does not follow the grammar."""
    inner = f"""transform(slice(_pieces, 1, size(_pieces) - 1), p -> CASE
        WHEN startswith(p, '{OPEN}') THEN struct(true AS loss, substr(p, {len(OPEN) + 1}) AS inner)
        WHEN startswith(p, '{OTHER_OPEN}') THEN struct(false AS loss, substr(p, {len(OTHER_OPEN) + 1}) AS inner)
        END)"""
    # put together again with the closing mark of each opening one, the turns must be the text
    again = f"array_join(transform(_cuts, x -> IF(x.loss, '{OPEN}' || x.inner || '{CLOSE}', '{OTHER_OPEN}' || x.inner || '{OTHER_CLOSE}')), '')"
    marked = f"exists(_cuts, x -> (contains(x.inner, '<') OR contains(x.inner, '[')) AND x.inner RLIKE {_MARK})"
    cut = df.withColumn("_pieces", F.expr(f"split({text}, {_CLOSING}, -1)")).withColumn("_cuts", F.expr(inner)).drop("_pieces")
    return cut.withColumn("_cuts", F.expr(f"IF(exists(_cuts, x -> x IS NULL) OR {again} <> {text} OR {marked}, NULL, _cuts)"))


def read_turns(df: DataFrame, text: str = "formatted", turns: str = "turns") -> DataFrame:
    """The parser: adds an array of (role, text), null where the text does not follow the grammar."""
    head = r"transform(_cuts, x -> struct(x.loss AS loss, x.inner AS inner, IF(x.loss, '', substring_index(x.inner, '\n', 1)) AS head))"
    role = f"CASE WHEN x.loss THEN '{ASSISTANT}' WHEN startswith(x.head, '=') THEN decode(unhex(substr(x.head, 2)), 'UTF-8') ELSE x.head END"
    body = "IF(x.loss, x.inner, substr(x.inner, char_length(x.head) + 2))"
    bodies = f"transform(_cuts, x -> struct({role} AS role, {body} AS body))"
    read = f"transform(_cuts, x -> struct(x.role AS role, {_unescaped('x.body')} AS text))"
    headed = _cut(df, text).withColumn("_cuts", F.expr(head)).withColumn("_cuts", F.expr(rf"IF(exists(_cuts, x -> NOT x.loss AND NOT contains(x.inner, '\n')), NULL, _cuts)"))
    return headed.withColumn("_cuts", F.expr(bodies)).withColumn(turns, F.expr(read)).drop("_cuts")


def read_loss_text(df: DataFrame, text: str = "formatted", spans: str = "loss_spans", loss: str = "loss") -> DataFrame:
    """Add all text under the loss mask, unescaped; an error where the mask is not that of the assistant's bodies.

    One walk over the pieces checks that the k-th span covers the k-th assistant body, and no span is left.
    """
    end = f"s.at + char_length(x.inner) + IF(x.loss, {len(OPEN) + len(CLOSE)}, {len(OTHER_OPEN) + len(OTHER_CLOSE)})"
    covered = f"coalesce(try_element_at({spans}, s.k + 1) = struct(s.at + {len(OPEN)}L AS start, {end} - {len(CLOSE)}L AS end), false)"
    walk = f"""aggregate(_cuts, named_struct('at', 0L, 'k', 0, 'fits', true), (s, x) -> named_struct(
        'at', {end}, 'k', s.k + int(x.loss), 'fits', s.fits AND (NOT x.loss OR {covered})))"""
    bodies = f"transform(filter(_cuts, x -> x.loss), x -> {_unescaped('x.inner')})"
    fits = f"coalesce(_walk.fits AND _walk.k = size({spans}), false)"
    error = "raise_error('the loss mask does not cover the assistant texts')"
    walked = _cut(df, text).withColumn("_walk", F.expr(walk))
    return walked.withColumn(loss, F.expr(f"IF({fits}, array_join({bodies}, ''), {error})")).drop("_cuts", "_walk")


def _rendered_turns(turns: DataFrame) -> DataFrame:
    """Add ``piece``: each turn rendered, with one mark after another escaped until it reads back as its source."""

    def read_back(df: DataFrame) -> DataFrame:
        """``_same`` where the turn is, or was before, read back as it is in the source."""
        back = read_turns(df.withColumn("piece", F.expr(f"IF(_same, piece, {_RENDERED})")).withColumn("_open", F.expr("IF(_same, '', piece)")), "_open", "_back")
        return back.withColumn("_same", F.expr("_same OR coalesce(_back = array(struct(role, text)), false)"))

    turns = read_back(turns.withColumns({"_body": F.col("text"), "_same": F.lit(False), "piece": F.lit("")}))
    for mark, escaped in _ESCAPES:
        turns = read_back(turns.withColumn("_body", F.expr(f"IF(_same, _body, regexp_replace(_body, {mark}, {escaped}))")))
    return turns


def format_conversations(
    rows: DataFrame, id_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role", text_column: str = "text"
) -> DataFrame:
    """One row per conversation: conv_id, n_turns, formatted, loss_spans (start, end in code points, end exclusive).

    ``formatted`` holds the turns by number; equal numbers go by role, then text. The loss spans cover the
    bodies of the assistant's turns, in order, as they stand in ``formatted`` (escaped). Every formatted
    text is read back once more, and an error is raised should its turns differ from the source.

    Null text or role: empty. A null turn goes first. Rows without an id make one conversation, with a null
    id. Repeated rows: each is a turn. Empty table: no rows. Other columns are not read. Texts and roles
    may hold anything. Rendering, reading and escaping work turn by turn; only then are the turns of a conversation
    joined, by a sort that can spill, into its text, which Spark holds as one value (up to 2 GB).
    """
    turns = rows.select(
        F.col(id_column).alias("conv_id"),
        F.col(turn_column).alias("turn"),
        F.coalesce(F.col(role_column).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"),
    )
    turns = _rendered_turns(turns).select("conv_id", "turn", "role", "text", "piece", F.expr("CAST(char_length(piece) AS BIGINT) AS size"))
    in_order = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = turns.withColumn("end", F.sum("size").over(in_order))
    # pieces are never empty, so the ends are unique and ascending
    joined = placed.groupBy("conv_id").agg(F.expr("sort_array(collect_list(struct(end, size, role, text, piece))) AS _turns"))
    loss = f"filter(_turns, t -> t.role = '{ASSISTANT}')"
    spans = f"transform({loss}, t -> struct(t.end - t.size + {len(OPEN)}L AS start, t.end - {len(CLOSE)}L AS end)) AS loss_spans"
    formatted = joined.selectExpr("conv_id", "_turns", "array_join(_turns.piece, '') AS formatted", spans)
    source = "transform(_turns, t -> struct(t.role AS role, t.text AS text))"
    error = "raise_error('a formatted conversation does not read back as its source')"
    proven = f"IF(coalesce(_back = {source}, false), formatted, {error}) AS formatted"
    return read_turns(formatted, "formatted", "_back").selectExpr("conv_id", "CAST(size(_turns) AS BIGINT) AS n_turns", proven, "loss_spans")
