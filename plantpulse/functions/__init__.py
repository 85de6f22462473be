from plantpulse.functions.moments import (
    as_moment,
    between_moments,
    day_floor,
    days_between,
    epoch_seconds,
    hour_floor,
    hours_between,
    minutes_between,
    moment,
)
from plantpulse.functions.numbers import (
    clamp,
    half_up,
    level,
    number_or,
    plain_number,
    rank_of,
    ratio,
    scaled_text,
    step_points,
    text_or,
)

__all__ = [
    "as_moment", "between_moments", "clamp", "day_floor", "days_between", "epoch_seconds",
    "half_up", "hour_floor", "hours_between", "level", "minutes_between", "moment",
    "number_or", "plain_number", "rank_of", "ratio", "scaled_text", "step_points", "text_or",
]
