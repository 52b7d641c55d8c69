"""Function names that Spark lacks or means otherwise, each as the Spark expression it stands for.

``{0}``, ``{1}`` ... are the arguments, ``{*}`` all of them. A name maps to one template, or to templates by number of
arguments; a name, or a number of arguments, that is not here is Spark's own. Expressions stay in the JVM; the few that
need Python are Arrow functions (``pyfuncs``), named ``loom_...``.
"""

from __future__ import annotations

INF = "CAST('Infinity' AS DOUBLE)"
#: The standard error of approx_distinct's sketch over windows where none is given.
SKETCH_ERROR = "0.01D"


def _log(call: str) -> str:
    """Logarithms are -infinity at 0 and NaN below, not NULL."""
    return f"CASE WHEN {{0}} = 0 THEN CAST('-Infinity' AS DOUBLE) WHEN {{0}} < 0 THEN CAST('NaN' AS DOUBLE) ELSE {call} END"


def _wilson(sign: str) -> str:
    s, n, z = "CAST({0} AS DOUBLE)", "CAST({1} AS DOUBLE)", "CAST({2} AS DOUBLE)"
    spread = f"{z} * sqrt(({s} / {n}) * (1 - {s} / {n}) / {n} + {z} * {z} / (4 * {n} * {n}))"
    return f"CASE WHEN {{1}} > 0 THEN ({s} / {n} + {z} * {z} / (2 * {n}) {sign} {spread}) / (1 + {z} * {z} / {n}) END"


def _hmac(digest: str, block: int) -> str:
    """HMAC of text {1} under key {0}: the digest of the key's outer pad and the digest of its inner pad and the text."""
    key, text = "CAST({0} AS BINARY)", "CAST({1} AS BINARY)"
    full = f"rpad(hex(CASE WHEN octet_length({key}) > {block} THEN {digest.format(key)} ELSE {key} END), {2 * block}, '0')"
    pad = lambda byte: f"unhex(array_join(transform(sequence(1, {2 * block}, 2), i -> lpad(hex(CAST(conv(substring({full}, i, 2), 16, 10) AS INT) ^ {byte}), 2, '0')), ''))"
    inner = digest.format(f"concat({pad(0x36)}, {text})")
    return f"lower(hex({digest.format(f'concat({pad(0x5C)}, {inner})')}))"


_DOT = "aggregate(zip_with({0}, {1}, (x, y) -> CAST(x AS DOUBLE) * CAST(y AS DOUBLE)), 0D, (a, x) -> a + x)"
_NORM = "sqrt(aggregate({%d}, 0D, (a, x) -> a + CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))"
_COSINE = f"({_DOT} / ({_NORM % 0} * {_NORM % 1}))"
_L2 = "sqrt(aggregate(zip_with({0}, {1}, (x, y) -> (CAST(x AS DOUBLE) - CAST(y AS DOUBLE)) * (CAST(x AS DOUBLE) - CAST(y AS DOUBLE))), 0D, (a, x) -> a + x))"
_AT = "variant_get(try_parse_json({0}), {1}, 'variant')"
_NESTED = f"(schema_of_variant({_AT}) LIKE 'OBJECT%' OR schema_of_variant({_AT}) LIKE 'ARRAY%')"
_SCALAR = f"CASE WHEN {_NESTED} THEN NULL ELSE get_json_object({{0}}, {{1}}) END"

# Choices of {1} elements, the first ones first: each element, from the last on, is put before what was chosen of those after it.
_COMBINATIONS = "filter(aggregate(reverse({0}), array(slice({0}, 1, 0)), (chosen, x) -> concat(transform(filter(chosen, c -> size(c) < {1}), c -> concat(array(x), c)), chosen)), c -> size(c) = {1})"

MATH = {
    "ceil": {1: "CAST(ceil({0}) AS DOUBLE)"}, "ceiling": {1: "CAST(ceil({0}) AS DOUBLE)"}, "floor": {1: "CAST(floor({0}) AS DOUBLE)"},
    "sign": "CAST(signum({0}) AS INT)",
    "truncate": {1: "CAST(CASE WHEN {0} < 0 THEN ceil({0}) ELSE floor({0}) END AS DOUBLE)"}, "trunc": {1: "CAST(CASE WHEN {0} < 0 THEN ceil({0}) ELSE floor({0}) END AS DOUBLE)"},
    "ln": _log("ln({0})"), "log": {1: _log("ln({0})")}, "log2": _log("log2({0})"), "log10": _log("log10({0})"),
    "infinity": INF, "nan": "CAST('NaN' AS DOUBLE)",
    "is_finite": f"CASE WHEN {{0}} IS NOT NULL THEN NOT isnan({{0}}) AND abs({{0}}) < {INF} END",
    "is_nan": "CASE WHEN {0} IS NOT NULL THEN isnan({0}) END",
    "is_infinite": f"CASE WHEN {{0}} IS NOT NULL THEN abs({{0}}) = {INF} END",
    "from_base": "CAST(conv({0}, {1}, 10) AS BIGINT)", "to_base": "lower(conv({0}, 10, {1}))",
    "wilson_interval_lower": _wilson("-"), "wilson_interval_upper": _wilson("+"),
    "beta_cdf": "loom_beta_cdf({*})", "inverse_beta_cdf": "loom_inverse_beta_cdf({*})", "normal_cdf": "loom_normal_cdf({*})",
    "inverse_normal_cdf": "loom_inverse_normal_cdf({*})", "t_cdf": "loom_t_cdf({*})", "t_pdf": "loom_t_pdf({*})",
    "cosine_similarity": _COSINE, "cosine_distance": f"(1 - {_COSINE})", "l2_distance": _L2, "euclidean_distance": _L2,
    "dot_product": _DOT, "inner_product": _DOT,
}

STRING = {
    "trim": {1: r"regexp_replace({0}, '^\\s+|\\s+$', '')", 2: "trim(BOTH {1} FROM {0})"}, "ltrim": {1: r"regexp_replace({0}, '^\\s+', '')", 2: "trim(LEADING {1} FROM {0})"}, "rtrim": {1: r"regexp_replace({0}, '\\s+$', '')", 2: "trim(TRAILING {1} FROM {0})"},
    "concat": "concat_ws('', {*})", "strpos": "CAST(instr({0}, {1}) AS BIGINT)", "length": {1: "CAST(length({0}) AS BIGINT)"},
    "split": {2: r"split({0}, concat('\\Q', {1}, '\\E'))"}, "split_part": {3: "CASE WHEN {2} > 0 THEN split_part({0}, {1}, greatest({2}, 1)) WHEN {2} IS NOT NULL AND {0} IS NOT NULL AND {1} IS NOT NULL THEN '' END"},
    "starts_with": "startswith({0}, {1})", "ends_with": "endswith({0}, {1})",
    "chr": "decode(unhex(lpad(hex({0}), 8, '0')), 'UTF-32')", "ascii": "CAST(ascii({0}) AS BIGINT)",
    "codepoint": "CASE WHEN {0} <> '' THEN CAST(ascii({0}) AS BIGINT) END",
    "hamming_distance": "CASE WHEN char_length({0}) = char_length({1}) THEN CAST(size(filter(zip_with(split({0}, ''), split({1}, ''), (x, y) -> x <> y), d -> d)) AS BIGINT) END",
    "levenshtein_distance": "CAST(levenshtein({0}, {1}) AS BIGINT)", "normalize": {1: "loom_normalize({0}, 'NFC')", 2: "loom_normalize({0}, {1})"},
    "to_utf8": "encode({0}, 'UTF-8')", "from_utf8": "CASE WHEN is_valid_utf8(CAST({0} AS STRING)) THEN decode({0}, 'UTF-8') END", "word_stem": "{0}",
}

_MONTHS = "(year({1}) * 12 + month({1})) - (year({0}) * 12 + month({0}))"
DATE = {
    "millisecond": "CAST((unix_micros(CAST({0} AS TIMESTAMP)) % 1000000) DIV 1000 AS INT)", "week": "weekofyear({0})", "week_of_year": "weekofyear({0})",
    "day_of_week": "dayofweek({0})", "dow": "dayofweek({0})", "day_of_year": "dayofyear({0})", "doy": "dayofyear({0})",
    "year_of_week": "CAST(extract(YEAROFWEEK FROM {0}) AS INT)", "timezone_hour": "CASE WHEN {0} IS NOT NULL THEN 0 END", "timezone_minute": "CASE WHEN {0} IS NOT NULL THEN 0 END",
    "localtime": "current_time()", "date_part": "CAST(date_part({0}, {1}) AS DOUBLE)", "last_day_of_month": "last_day({0})",
    "from_unixtime": {1: "timestamp_seconds({0})"}, "to_unixtime": "unix_seconds(CAST({0} AS TIMESTAMP))",
    "from_iso8601_timestamp": "try_to_timestamp({0})", "from_iso8601_date": "CAST(try_to_timestamp({0}, 'yyyy-MM-dd') AS DATE)",
    "to_iso8601": "CASE WHEN typeof({0}) = 'date' THEN date_format({0}, 'yyyy-MM-dd') ELSE date_format({0}, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'\") END",
    "parse_datetime": "try_to_timestamp({0}, {1})",
    "human_readable_seconds": "CASE WHEN abs({0}) < 60 THEN format_string('%.2f seconds', CAST({0} AS DOUBLE)) WHEN abs({0}) < 3600 THEN format_string('%.2f minutes', {0} / 60D) WHEN abs({0}) < 86400 THEN format_string('%.2f hours', {0} / 3600D) ELSE format_string('%.2f days', {0} / 86400D) END",
    "with_timezone": "{0}", "timezone": "CASE WHEN {0} IS NOT NULL THEN 'UTC' END",
    "parse_duration": "CAST(try_to_number(regexp_extract({0}, '^([0-9.]+)', 1), '999999999999.999999') * CASE regexp_extract({0}, '([a-z]+)$', 1) WHEN 'ns' THEN 1e-9BD WHEN 'us' THEN 1e-6BD WHEN 'ms' THEN 1e-3BD WHEN 's' THEN 1 WHEN 'm' THEN 60 WHEN 'h' THEN 3600 WHEN 'd' THEN 86400 END AS DOUBLE)",
}

# The high half is moved up and the low half joined on: conv() reads no more than 63 bits as a number.
_HALF = "CAST(conv(hex(substring({0}, %d, 4)), 16, 10) AS BIGINT)"
_LONG_OF_BYTES = f"CASE WHEN octet_length({{0}}) >= 8 THEN shiftleft({_HALF % 1}, 32) | {_HALF % 5} END"

OTHER = {
    "try": "{0}", "format": "format_string({*})", "format_number": {1: "format_number({0}, 0)"},
    "parse_data_size": "CAST(try_cast(regexp_extract(trim({0}), '^([0-9.]+)', 1) AS DOUBLE) * CASE upper(regexp_extract(trim({0}), '([A-Za-z]+)$', 1)) WHEN 'B' THEN 1 WHEN 'KB' THEN 1024 WHEN 'MB' THEN 1048576 WHEN 'GB' THEN 1073741824 WHEN 'TB' THEN 1099511627776 END AS BIGINT)",
    "regexp_extract": {2: "CASE WHEN regexp_like({0}, {1}) THEN regexp_extract({0}, {1}, 0) END", 3: "CASE WHEN regexp_like({0}, {1}) THEN regexp_extract({0}, {1}, {2}) END"},
    "regexp_extract_all": {2: "regexp_extract_all({0}, {1}, 0)"}, "regexp_split": "split({0}, {1})", "regexp_count": "CAST(regexp_count({0}, {1}) AS BIGINT)",
    "regexp_position": "CAST(nullif(regexp_instr({0}, {1}), 0) AS BIGINT)",
    "to_hex": "lower(hex({0}))", "from_hex": "try_to_binary({0}, 'hex')", "to_base64": "base64(CAST({0} AS BINARY))", "from_base64": "try_to_binary({0}, 'base64')",
    "to_base64url": "translate(base64(CAST({0} AS BINARY)), '+/', '-_')", "from_base64url": "try_to_binary(translate({0}, '-_', '+/'), 'base64')",
    "to_base32": "loom_to_base32(CAST({0} AS BINARY))", "from_base32": "loom_from_base32({0})", "sha256": "sha2({0}, 256)", "sha512": "sha2({0}, 512)",
    "crc32": "CAST(CASE WHEN crc32({0}) > 2147483647 THEN crc32({0}) - 4294967296 ELSE crc32({0}) END AS INT)",
    "xxhash64": {1: "loom_xxhash64(CAST({0} AS BINARY))"}, "murmur3": "hash({0})",
    "hmac_md5": _hmac("unhex(md5({}))", 64), "hmac_sha1": _hmac("unhex(sha1({}))", 64), "hmac_sha256": _hmac("unhex(sha2({}, 256))", 64), "hmac_sha512": _hmac("unhex(sha2({}, 512))", 128),
    "from_big_endian_32": "CASE WHEN octet_length({0}) >= 4 THEN CAST(shiftright(shiftleft(CAST(conv(hex(substring({0}, 1, 4)), 16, 10) AS BIGINT), 32), 32) AS INT) END",
    "to_big_endian_32": "unhex(lpad(right(hex({0}), 8), 8, '0'))", "from_big_endian_64": _LONG_OF_BYTES, "to_big_endian_64": "unhex(lpad(hex({0}), 16, '0'))",
    "from_ieee754_32": "CAST(loom_unpack_double('>f', {0}) AS FLOAT)", "to_ieee754_32": "loom_pack('>f', {0})", "from_ieee754_64": "loom_unpack_double('>d', {0})", "to_ieee754_64": "loom_pack('>d', {0})",
    "bitwise_and": "({0} & {1})", "bitwise_or": "({0} | {1})", "bitwise_xor": "({0} ^ {1})", "bitwise_not": "(~{0})", "bit_not": "(~{0})",
    "bit_and": {2: "({0} & {1})"}, "bit_or": {2: "({0} | {1})"}, "bit_xor": {2: "({0} ^ {1})"},
    "bitwise_left_shift": "shiftleft(CAST({0} AS BIGINT), CAST({1} AS INT))", "bitwise_right_shift": "shiftrightunsigned(CAST({0} AS BIGINT), CAST({1} AS INT))",
    "bitwise_right_shift_arithmetic": "shiftright(CAST({0} AS BIGINT), CAST({1} AS INT))",
    "url_extract_host": "try_parse_url({0}, 'HOST')", "url_extract_path": "try_parse_url({0}, 'PATH')", "url_extract_protocol": "try_parse_url({0}, 'PROTOCOL')",
    "url_extract_query": "try_parse_url({0}, 'QUERY')", "url_extract_fragment": "try_parse_url({0}, 'REF')",
    "url_extract_port": r"CAST(nullif(regexp_extract(try_parse_url({0}, 'AUTHORITY'), ':(\\d+)$', 1), '') AS BIGINT)",
    "url_extract_parameter": "try_url_decode(try_parse_url({0}, 'QUERY', {1}))", "url_encode": "replace(url_encode({0}), '+', '%20')", "url_decode": "try_url_decode(replace({0}, '+', '%2B'))",
    "json_extract": f"to_json({_AT})", "json_extract_scalar": _SCALAR, "json_value": _SCALAR, "json_query": f"CASE WHEN {_NESTED} THEN to_json({_AT}) END",
    "json_exists": f"coalesce({_AT} IS NOT NULL, false)", "json_array_get": "to_json(try_element_at(try_variant_get(try_parse_json({0}), '$', 'array<variant>'), CASE WHEN {1} < 0 THEN CAST({1} AS INT) ELSE CAST({1} + 1 AS INT) END))",
    "json_size": {
        1: "CAST(CASE WHEN schema_of_variant(try_parse_json({0})) LIKE 'ARRAY%' THEN json_array_length({0}) WHEN schema_of_variant(try_parse_json({0})) LIKE 'OBJECT%' THEN size(json_object_keys({0})) WHEN try_parse_json({0}) IS NOT NULL THEN 0 END AS BIGINT)",
        2: f"CAST(CASE WHEN schema_of_variant({_AT}) LIKE 'ARRAY%' THEN json_array_length(to_json({_AT})) WHEN schema_of_variant({_AT}) LIKE 'OBJECT%' THEN size(json_object_keys(to_json({_AT}))) WHEN {_AT} IS NOT NULL THEN 0 END AS BIGINT)",
    },
    "json_array_length": "CAST(json_array_length({0}) AS BIGINT)", "json_array_contains": "coalesce(array_contains(from_json({0}, 'array<string>'), CAST({1} AS STRING)), false)",
    "is_json_scalar": "coalesce(NOT (schema_of_variant(try_parse_json({0})) LIKE 'OBJECT%' OR schema_of_variant(try_parse_json({0})) LIKE 'ARRAY%'), false)",
    "json_format": "loom_json_format({0})", "json_parse": "CASE WHEN try_parse_json({0}) IS NOT NULL THEN {0} END", "json_object": "to_json(named_struct({*}), map('ignoreNullFields', 'false'))", "json_array": "to_json(array({*}))", "json_keys": "json_object_keys({0})",
}

ARRAY = {
    "cardinality": "CAST(size({0}) AS BIGINT)", "array_length": "CAST(size({0}) AS BIGINT)", "element_at": "try_element_at({0}, {1})", "contains": "array_contains({0}, {1})",
    "array_position": "CAST(array_position({0}, {1}) AS BIGINT)", "array_concat": "concat({*})", "array_reverse": "reverse({0})", "trim_array": "slice({0}, 1, size({0}) - {1})",
    "ngrams": "transform(sequence(1, greatest(size({0}) - {1} + 1, 1)), i -> slice({0}, i, {1}))", "combinations": _COMBINATIONS,
    "array_first": "try_element_at({0}, 1)", "array_last": "try_element_at({0}, -1)", "zip": "arrays_zip({*})",
    "contains_sequence": "(size({1}) = 0 OR (size({0}) >= size({1}) AND exists(sequence(1, greatest(size({0}) - size({1}) + 1, 1)), i -> slice({0}, i, size({1})) = {1})))",
}

# Exact, as in the reference, and within any error that a second argument allows. A sketch beside a DISTINCT aggregate would be
# kept once for each distinct value: Spark first groups by those.
_EXACT_DISTINCT = "count(DISTINCT {0})"
AGGREGATE = {
    "var": "var_samp({0})", "arbitrary": "any_value({0}, true)", "any_value": {1: "any_value({0}, true)"}, "geometric_mean": "exp(avg(CASE WHEN {0} > 0 THEN ln({0}) END))",
    "checksum": "coalesce(bit_xor({0}), 0)", "bitwise_and_agg": "bit_and({0})", "bitwise_or_agg": "bit_or({0})", "bitwise_xor_agg": "coalesce(bit_xor({0}), 0)",
    "group_concat": {1: "listagg({0}, ',')", 2: "listagg({0}, {1})"}, "string_agg": {1: "listagg({0}, ',')", 2: "listagg({0}, {1})"}, "listagg": {1: "listagg({0}, ',')"},
    "kurtosis": "CASE WHEN count({0}) >= 4 THEN kurtosis({0}) END", "skewness": "CASE WHEN count({0}) >= 3 THEN skewness({0}) END",
    "approx_distinct": {1: _EXACT_DISTINCT, 2: _EXACT_DISTINCT}, "approx_count_distinct": {1: _EXACT_DISTINCT, 2: _EXACT_DISTINCT}, "approx_percentile": {1: "CAST(percentile_approx({0}, 0.5D, 1000000) AS DOUBLE)", 2: "CAST(percentile_approx({0}, {1}, 1000000) AS DOUBLE)"},
}

_SKETCHED_DISTINCT = {1: f"approx_count_distinct({{0}}, {SKETCH_ERROR})", 2: "approx_count_distinct({0}, {1})"}
#: Before OVER: Spark has no DISTINCT in windows.
WINDOWED: dict[str, dict[int, str]] = {"approx_distinct": _SKETCHED_DISTINCT, "approx_count_distinct": _SKETCHED_DISTINCT}

MACROS: dict[str, str | dict[int, str]] = MATH | STRING | DATE | OTHER | ARRAY | AGGREGATE

#: Refused by name: there is no public Spark expression for them and the reference has none either.
REFUSED = {"spooky_hash_v2_32", "spooky_hash_v2_64"}

#: MySQL date format letters in Java's pattern letters.
MYSQL_TO_JAVA = {"Y": "yyyy", "y": "yy", "m": "MM", "c": "M", "d": "dd", "e": "d", "H": "HH", "k": "H", "h": "hh", "I": "hh", "l": "h", "i": "mm", "s": "ss", "S": "ss", "f": "SSSSSS", "p": "a", "W": "EEEE", "a": "EEE", "M": "MMMM", "b": "MMM", "j": "DDD", "T": "HH:mm:ss", "%": "'%'"}


def java_format(mysql: str) -> str:
    """A MySQL date format as Java's pattern; other letters are quoted."""
    out, literal, i = [], "", 0
    while i < len(mysql):
        c = mysql[i]
        if c == "%" and i + 1 < len(mysql):
            i += 1
            piece = MYSQL_TO_JAVA.get(mysql[i])
            if piece is None:
                literal += mysql[i]
            else:
                out += [f"'{literal}'"] * bool(literal) + [piece]
                literal = ""
        elif c.isalpha():
            literal += c
        else:
            out += [f"'{literal}'"] * bool(literal) + ["''" if c == "'" else c]
            literal = ""
        i += 1
    return "".join(out + [f"'{literal}'"] * bool(literal))
