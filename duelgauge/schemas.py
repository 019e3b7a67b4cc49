"""Schemas of the engine's tables."""

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


_TEXT, _LONG, _REAL = T.StringType(), T.LongType(), T.DoubleType()
_TAGS = T.MapType(_TEXT, _TEXT)

GAMES = _struct(
    game_id=_TEXT,
    source=_TEXT,
    line_no=_LONG,
    played_at=T.DateType(),
    event=_TEXT,
    white=_TEXT,
    black=_TEXT,
    white_elo=_LONG,
    black_elo=_LONG,
    result=_LONG,
    record=_TEXT,
)
MOVES = _struct(game_id=_TEXT, ply=_LONG, color=_TEXT, move=_TEXT, clock_s=_LONG, props=_TAGS)
MOVE_SCORES = _struct(game_id=_LONG, ply=_LONG, color=_TEXT, score=_REAL)
GAME_SCORES = _struct(
    low=_LONG,
    high=_LONG,
    white_rating=_LONG,
    black_rating=_LONG,
    white_score=_REAL,
    white_moves=_LONG,
    black_score=_REAL,
    black_moves=_LONG,
)
CALIBRATION = _struct(low=_LONG, high=_LONG, center=_REAL, games=_LONG, moves=_REAL, mean_score=_REAL)
OCCUPANCY = _struct(
    game_id=_LONG, ply=_LONG, white=_LONG, black=_LONG, kings=_LONG, pawns=_LONG, problem=_TEXT
)
METRICS = _struct(
    n_examples=_LONG,
    accuracy=_REAL,
    draw_rate=_REAL,
    log_loss=_REAL,
    brier_score=_REAL,
    slices=T.MapType(_TEXT, T.MapType(_TEXT, T.ArrayType(_REAL))),
)
PLAYER_RECORD = _struct(
    id=_TEXT,
    perfs=_struct(rapid=_struct(rating=_LONG, prov=T.BooleanType(), games=_LONG)),
    closed=T.BooleanType(),
    tosViolation=T.BooleanType(),
)


def check_schema(df, expected: T.StructType) -> None:
    """Fail when a column of the expected schema is missing or of another type."""
    found = {f.name: f.dataType for f in df.schema.fields}
    wrong = [f.name for f in expected.fields if found.get(f.name) != f.dataType]
    if wrong:
        raise ValueError(f"columns missing or of another type: {wrong}")
