"""Rating, probability and score expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The two published score-to-Elo lines (slope, intercept) and the default draw rate.
DEFAULT_LINE = (2099.249546736356, 1374.608727864828)
LEGACY_LINE = (357.702991, 1941.294157)
DRAW_RATE = 0.04
LOG_FLOOR = 1e-15


def color_move_count(plies: Column, color: str) -> Column:
    return F.floor((plies + (1 if color == "white" else 0)) / 2)


def result_sign(raw: Column) -> Column:
    """-1, 0 or 1 from a numeric text or a 1-0 / 0-1 / draw text; NULL for a non-numeric tag."""
    return (
        F.when(raw == "1-0", F.lit(1.0))
        .when(raw == "0-1", F.lit(-1.0))
        .when(raw.isin("1/2-1/2", "*"), F.lit(0.0))
        .otherwise(F.signum(raw.try_cast("double")))
    ).cast("bigint")


def outcome_name(outcome: Column) -> Column:
    return F.when(outcome > 0, "win").when(outcome < 0, "loss").otherwise("draw")


def _triple(white: Column, draw: Column, black: Column) -> Column:
    """Struct of three probabilities with the argmax; ties resolve white, draw, black."""
    top = F.greatest(white, draw, black)
    predicted = F.when(white == top, 1).when(draw == top, 0).otherwise(-1).cast("bigint")
    return F.struct(
        white.alias("p_white"), draw.alias("p_draw"), black.alias("p_black"), predicted.alias("predicted")
    )


def strength_to_probs(
    white: Column, black: Column, draw_rate: float = DRAW_RATE, scale: float = 1.0, color_bias: float = 0.0
) -> Column:
    """Natural logistic of the scaled strength difference."""
    diff = (white - black) * scale + color_bias
    rest = 1.0 - draw_rate
    return _triple(rest / (1.0 + F.exp(-diff)), F.lit(float(draw_rate)), rest / (1.0 + F.exp(diff)))


def elo_to_probs(white: Column, black: Column, draw_rate: float = DRAW_RATE, color_bias: float = 0.0) -> Column:
    """Base-10 logistic of the rating difference."""
    expected = 1.0 / (1.0 + F.pow(F.lit(10.0), (black - white - color_bias) / 400.0))
    rest = 1.0 - draw_rate
    return _triple(rest * expected, F.lit(float(draw_rate)), rest * (1.0 - expected))


def rating_baseline(white_elo: Column, black_elo: Column, draw_rate: float = DRAW_RATE) -> Column:
    """Natural logistic of the rating difference over 400."""
    return strength_to_probs((white_elo - black_elo) / 400.0, F.lit(0.0), draw_rate)


def score_to_elo(score: Column, line: tuple[float, float] = DEFAULT_LINE) -> Column:
    return F.lit(line[0]) * score + F.lit(line[1])


def invert_line(score: Column, slope: Column, intercept: Column) -> Column:
    return (score - intercept) / slope


def step_elo(win_rate: Column) -> Column:
    """Rating step for a win rate, clamped to ±1000; certain results count as the clamp."""
    step = -F.greatest(F.least(F.lit(1000.0), 400.0 * F.log10((1.0 - win_rate) / win_rate)), F.lit(-1000.0))
    return F.when(win_rate >= 1.0, F.lit(1000.0)).when(win_rate <= 0.0, F.lit(-1000.0)).otherwise(step)


def elo_bucket(white_elo: Column, black_elo: Column, width: int = 200) -> Column:
    low = F.floor(F.floor((white_elo + black_elo) / 2) / width) * width
    return F.concat_ws("-", low.cast("string"), (low + width).cast("string"))


def difference_bucket(white_elo: Column, black_elo: Column, width: int = 30) -> Column:
    low = F.floor(F.abs(white_elo - black_elo) / width) * width
    return F.concat_ws("-", low.cast("string"), (low + width).cast("string"))


def month_bucket(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def probability_of(result: Column, white: Column, draw: Column, black: Column) -> Column:
    return F.when(result > 0, white).when(result == 0, draw).otherwise(black)


def log_loss(result: Column, white: Column, draw: Column, black: Column) -> Column:
    return -F.ln(F.greatest(probability_of(result, white, draw, black), F.lit(LOG_FLOOR)))


def brier(result: Column, white: Column, draw: Column, black: Column) -> Column:
    def part(sign: int, p: Column) -> Column:
        gap = F.when(F.signum(result) == sign, F.lit(1.0)).otherwise(F.lit(0.0)) - p
        return gap * gap

    return part(1, white) + part(0, draw) + part(-1, black)


def winner_sign(result: Column) -> Column:
    return F.signum(result).cast("bigint")


def winner_probability(result: Column, white: Column, black: Column) -> Column:
    return F.when(result > 0, white).when(result < 0, black)
