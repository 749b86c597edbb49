"""GoogleSQL-named functions where Spark's own differ, as Column functions.

Everything here is an expression of Spark's built-ins, except for NORMALIZE and the JSON edits, which are Arrow-batched pandas UDFs.
"""

from .aggregates import approx_quantiles, array_agg, array_concat_agg, countif, logical_and, logical_or, string_agg
from .arrays import array_length, array_to_string, generate_array, offset, ordinal, safe_offset, safe_ordinal
from .dates import date_diff, date_trunc, datetime_diff, extract_week, format_date, parse_date, timestamp_diff
from .json import (
    json_keys_sorted, json_query, json_query_array, json_remove, json_set, json_type, json_value, json_value_array, lax_bool, lax_float64, lax_int64, lax_string, to_json_string,
)
from .numbers import cast_float_to_int, cast_format, equal_nan, greatest, ieee_divide, least, log, nan_first, numeric, parse_numeric, range_bucket, round_half_away, safe_divide
from .strings import code_points_to_string, contains_substr, md5_bytes, net_host, net_ip_from_string, normalize, regexp_extract, regexp_replace, split, substr, to_code_points, to_hex

__all__ = [n for n in dir() if not n.startswith("_") and n not in {"aggregates", "arrays", "dates", "json", "numbers", "strings"}]
