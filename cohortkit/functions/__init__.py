from cohortkit.functions.core import (  # noqa: F401
    US_PER_DAY,
    add_scalars,
    fnum,
    is_negative,
    micros_between,
    nan_to_null,
    not_zero,
    whole_days,
)
