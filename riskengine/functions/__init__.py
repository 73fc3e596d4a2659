from riskengine.functions.scalar import (  # noqa: F401
    clip, np_round, percent_text, sigmoid, to_number, to_int_target, parse_percent,
)
