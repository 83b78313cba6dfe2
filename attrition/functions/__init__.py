"""Column-level helpers shared by the operators."""

from attrition.functions.nulls import (  # noqa: F401
    count_equal, if_else_null, in_set, not_in, pmax, pmin,
)
from attrition.functions.exprs import (  # noqa: F401
    cut_right_closed, hex_digits_value, md5_key, yes_no,
)
