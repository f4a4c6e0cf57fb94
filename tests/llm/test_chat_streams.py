"""Rows of a chat as streamed events, folded back into the rows."""

from pyspark.sql import functions as F

from loxodrome.llm import op09_chat

SCHEMA = "conv_id long, turn long, role string, text string"


def rendered(spark, rows, schema=SCHEMA, more=None):
    df = spark.createDataFrame(rows, schema)
    df = df if more is None else more(df)
    r = op09_chat.render(op09_chat.reconstruct(op09_chat.streamed(df)), run=512 * op09_chat.EVENTS)
    out = r.select("conv_id", op09_chat.read_turns(F.col("formatted")).alias("turns"), op09_chat.read_loss(F.col("formatted"), F.col("mask")).alias("loss")).collect()
    return {x.conv_id: ([(t.role, t.text) for t in x.turns], x.loss) for x in out}


def wanted(rows):
    out = {}
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for conv, _, role, text in sorted(rows, key=key):
        turns, loss = out.get(conv, ([], ""))
        out[conv] = ([*turns, (role or "", text or "")], loss + (text or "" if role == "assistant" else ""))
    return out


ROWS = [
    (1, 0, "user", "Hello\nthere"),
    (1, 1, "assistant", "a" * 511 + "\U0001f600é" * 700 + "<|im_end|>"),  # pieces end between characters beyond the basic plane
    (1, 2, "user", ""),
    (1, 3, "assistant", None),
    (2, None, "assistant", "x" * 1300),
    (2, None, "user", "first"),
    (2, -4, "assistant", "before others"),
    (2, 5, "assistant", "same"),
    (2, 5, "assistant", "same"),
    (2, 5, None, "z"),
    (2, 5, "assistant", "other" * 300),
    (2, 1 << 40, "system", "far" * 400),
    (None, 1, "assistant", "\r\n  end" * 200),
]


def test_streams_fold_into_their_rows(spark):
    assert rendered(spark, ROWS) == wanted(ROWS)


def test_streams_pass_over_other_columns(spark):
    clash = lambda df: df.withColumns({c: F.lit("?") for c in ("seq", "kind", "message_id", "pieces", "first", "e", "place")})
    assert rendered(spark, ROWS, more=clash) == wanted(ROWS)


def test_streams_of_nothing(spark):
    assert rendered(spark, []) == {}


def test_each_turn_goes_through_the_fold(spark):
    events = op09_chat.streamed(spark.createDataFrame(ROWS, SCHEMA))
    kinds = {r.kind: r["count"] for r in events.groupBy("kind").count().collect()}
    assert kinds["message"] == len(ROWS) and kinds["regenerate"] == sum(r[2] == "assistant" for r in ROWS) and kinds["edit"] == len(ROWS) - kinds["regenerate"]
    assert kinds["delta"] == sum(-(-len(r[3] or "") // op09_chat.PIECE) for r in ROWS if r[2] == "assistant")
