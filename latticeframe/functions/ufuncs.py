"""NumPy ufuncs as Spark SQL expressions with NumPy's results for zeros, NaN and infinities (not ANSI errors or NULL).

{x} and {y} are columns of type DOUBLE, or BIGINT for the integer forms. Names that NumPy has as aliases share a form.
"""

from __future__ import annotations

NAN, INF, NINF = "double('nan')", "double('infinity')", "double('-infinity')"
NEG0 = "(cast({%s} as string) = '-0.0')"
EITHER_NAN = "(isnan({x}) or isnan({y}))"


def _fill(template: str) -> str:
    return template.replace("NINF", NINF).replace("INF_", INF).replace("NAN_", NAN).replace("NEG0X", NEG0 % "x").replace("NEG0Y", NEG0 % "y")


#: One argument, DOUBLE.
UNARY = {k: _fill(v) for k, v in {
    "negative": "-{x}", "positive": "{x}", "square": "{x} * {x}", "absolute": "abs({x})", "fabs": "abs({x})",
    "sign": "sign({x})", "conjugate": "{x}",
    "reciprocal": "case when {x} = 0 then if(NEG0X, NINF, INF_) else 1D / {x} end",
    "sqrt": "sqrt({x})", "cbrt": "cbrt({x})", "exp": "exp({x})", "expm1": "expm1({x})", "exp2": "power(2D, {x})",
    "log": "case when {x} = 0 then NINF when {x} < 0 then NAN_ else ln({x}) end",
    "log2": "case when {x} = 0 then NINF when {x} < 0 then NAN_ else log2({x}) end",
    "log10": "case when {x} = 0 then NINF when {x} < 0 then NAN_ else log10({x}) end",
    "log1p": "case when {x} = -1 then NINF when {x} < -1 then NAN_ else log1p({x}) end",
    "sin": "sin({x})", "cos": "cos({x})", "tan": "tan({x})", "arcsin": "asin({x})", "arccos": "acos({x})", "arctan": "atan({x})",
    "sinh": "sinh({x})", "cosh": "cosh({x})", "tanh": "tanh({x})", "arcsinh": "asinh({x})", "arccosh": "acosh({x})", "arctanh": "atanh({x})",
    "degrees": "degrees({x})", "rad2deg": "degrees({x})", "radians": "radians({x})", "deg2rad": "radians({x})", "rint": "rint({x})",
    "floor": "if(abs({x}) < 9e15, double(floor({x})), {x})", "ceil": "if(abs({x}) < 9e15, double(ceil({x})), {x})",
    "trunc": "if(abs({x}) < 9e15, double(if({x} < 0, ceil({x}), floor({x}))), {x})",
    "isnan": "isnan({x})", "isinf": "({x} = INF_ or {x} = NINF)", "isfinite": "not (isnan({x}) or {x} = INF_ or {x} = NINF)",
    "signbit": "(({x} < 0 and not isnan({x})) or NEG0X)", "logical_not": "({x} = 0)",
}.items()}

#: Two arguments, DOUBLE.
BINARY = {k: _fill(v) for k, v in {
    "add": "{x} + {y}", "subtract": "{x} - {y}", "multiply": "{x} * {y}",
    "divide": "case when {y} <> 0 or isnan({y}) then {x} / {y} when isnan({x}) or {x} = 0 then NAN_ when ({x} > 0) = (not NEG0Y) then INF_ else NINF end",
    "remainder": "case when {y} = 0 then NAN_ when {x} % {y} <> 0 and ({x} % {y} < 0) <> ({y} < 0) then {x} % {y} + {y} else {x} % {y} end",
    "fmod": "if({y} = 0, NAN_, {x} % {y})",
    "power": "case when {x} = 1 or {y} = 0 or ({x} = -1 and ({y} = INF_ or {y} = NINF)) then 1D else power({x}, {y}) end",
    "arctan2": "atan2({x}, {y})", "hypot": "hypot({x}, {y})",
    "logaddexp": "if({x} = {y}, {x} + ln(2D), greatest({x}, {y}) + log1p(exp(-abs({x} - {y}))))",
    "logaddexp2": "if({x} = {y}, {x} + 1D, greatest({x}, {y}) + log1p(power(2D, -abs({x} - {y}))) / ln(2D))",
    "maximum": "if(isnan({x}) or isnan({y}), NAN_, greatest({x}, {y}))", "minimum": "if(isnan({x}) or isnan({y}), NAN_, least({x}, {y}))",
    "fmax": "case when isnan({x}) then {y} when isnan({y}) then {x} else greatest({x}, {y}) end",
    "fmin": "case when isnan({x}) then {y} when isnan({y}) then {x} else least({x}, {y}) end",
    "equal": f"(not {EITHER_NAN} and {{x}} = {{y}})", "not_equal": f"({EITHER_NAN} or {{x}} <> {{y}})",
    "less": f"(not {EITHER_NAN} and {{x}} < {{y}})", "less_equal": f"(not {EITHER_NAN} and {{x}} <= {{y}})",
    "greater": f"(not {EITHER_NAN} and {{x}} > {{y}})", "greater_equal": f"(not {EITHER_NAN} and {{x}} >= {{y}})",
    "logical_and": "({x} <> 0 and {y} <> 0)", "logical_or": "({x} <> 0 or {y} <> 0)", "logical_xor": "(({x} <> 0) <> ({y} <> 0))",
    "copysign": "if(({y} < 0 and not isnan({y})) or NEG0Y, -abs({x}), abs({x}))",
    "heaviside": "case when isnan({x}) then {x} when {x} < 0 then 0D when {x} = 0 then {y} else 1D end",
    "ldexp": "{x} * power(2D, {y})",
}.items()}
_floor_div = BINARY["divide"]
BINARY["floor_divide"] = f"case when {{y}} = 0 then {_floor_div} when isnan({{x}} / {{y}}) then {NAN} else if(abs({{x}} / {{y}}) < 9e15, double(floor(({{x}} - ({BINARY['remainder']})) / {{y}} + 0.5D)), floor({{x}} / {{y}})) end"
BINARY["float_power"] = BINARY["power"]

#: Integer forms (BIGINT in and out; comparisons and logic share the forms above without NaN).
INT_UNARY = {
    "negative": "-{x}", "positive": "{x}", "square": "{x} * {x}", "absolute": "abs({x})", "sign": "bigint(sign({x}))", "conjugate": "{x}",
    "invert": "~{x}", "bitwise_count": "bit_count(abs({x}))", "floor": "{x}", "ceil": "{x}", "trunc": "{x}", "logical_not": "({x} = 0)",
    "isnan": "false", "isinf": "false", "isfinite": "true",
}
INT_BINARY = {
    "add": "{x} + {y}", "subtract": "{x} - {y}", "multiply": "{x} * {y}",
    "floor_divide": "case when {y} = 0 then 0L when {x} % {y} <> 0 and ({x} < 0) <> ({y} < 0) then {x} div {y} - 1 else {x} div {y} end",
    "remainder": "case when {y} = 0 then 0L when {x} % {y} <> 0 and ({x} % {y} < 0) <> ({y} < 0) then {x} % {y} + {y} else {x} % {y} end",
    "fmod": "if({y} = 0, 0L, {x} % {y})", "maximum": "greatest({x}, {y})", "minimum": "least({x}, {y})", "fmax": "greatest({x}, {y})", "fmin": "least({x}, {y})",
    "power": "if({y} < 0, bigint(raise_error('integers to negative integer powers are not allowed')), case when {y} = 0 or {x} = 1 then 1L when {x} = 0 then 0L when {x} = -1 then if({y} % 2 = 0, 1L, -1L) else aggregate(sequence(1, int(least({y}, 64L))), 1L, (p, i) -> p * {x}) end)",
    "equal": "({x} = {y})", "not_equal": "({x} <> {y})", "less": "({x} < {y})", "less_equal": "({x} <= {y})", "greater": "({x} > {y})", "greater_equal": "({x} >= {y})",
    "logical_and": "({x} <> 0 and {y} <> 0)", "logical_or": "({x} <> 0 or {y} <> 0)", "logical_xor": "(({x} <> 0) <> ({y} <> 0))",
    "bitwise_and": "{x} & {y}", "bitwise_or": "{x} | {y}", "bitwise_xor": "{x} ^ {y}",
    "left_shift": "shiftleft({x}, int({y}))", "right_shift": "shiftright({x}, int({y}))",
}
#: Complex forms: real and imaginary part of the result, from {x}, {xi} and {y}, {yi}.
COMPLEX = {
    "add": ("{x} + {y}", "{xi} + {yi}"), "subtract": ("{x} - {y}", "{xi} - {yi}"),
    "multiply": ("{x} * {y} - {xi} * {yi}", "{x} * {yi} + {xi} * {y}"),
    "divide": ("try_divide({x} * {y} + {xi} * {yi}, {y} * {y} + {yi} * {yi})", "try_divide({xi} * {y} - {x} * {yi}, {y} * {y} + {yi} * {yi})"),
    "negative": ("-{x}", "-{xi}"), "positive": ("{x}", "{xi}"), "conjugate": ("{x}", "-{xi}"), "square": ("{x} * {x} - {xi} * {xi}", "2D * {x} * {xi}"),
    "exp": ("exp({x}) * cos({xi})", "exp({x}) * sin({xi})"), "reciprocal": ("try_divide({x}, {x} * {x} + {xi} * {xi})", "try_divide(-{xi}, {x} * {x} + {xi} * {xi})"),
    "absolute": ("hypot({x}, {xi})", None), "equal": ("({x} = {y} and {xi} = {yi})", None), "not_equal": ("({x} <> {y} or {xi} <> {yi})", None),
    "isnan": ("(isnan({x}) or isnan({xi}))", None), "isfinite": (f"({UNARY['isfinite']} and {UNARY['isfinite'].replace('{x}', '{xi}')})", None),
}
