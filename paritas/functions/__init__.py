"""Column expressions: value matching, row encoding and SAS scalar semantics."""

from paritas.functions.match import (  # noqa: F401
    FLOAT_TYPES, is_float_type, row_hash, row_line, values_match,
)
from paritas.functions.sas import (  # noqa: F401
    normalize_value, sas_date_to_iso, sas_day_from_date, sas_eq, sas_ge, sas_gt,
    sas_le, sas_lt, sas_ne, sas_sort_order, sas_text_eq, to_sas_char, to_sas_num,
)
