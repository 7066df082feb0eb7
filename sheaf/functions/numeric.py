"""PDF functions of types 0, 2, 3 and 4: as Python callables, and where possible as Column expressions."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from sheaf.sources.syntax import Fault, Reader, Stream, Token

Function = Callable[[list[float]], list[float]]


def clip(x: float, low: float, high: float) -> float:
    return min(max(x, low), high)


def interpolate(x: float, a: float, b: float, c: float, d: float) -> float:
    """x of a..b carried to c..d; c where a..b is one point."""
    return c if a == b else c + (x - a) * (d - c) / (b - a)


def clip_column(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high)))


def interpolate_column(x: Column, a: float, b: float, c: float, d: float) -> Column:
    return F.lit(float(c)) if a == b else F.lit(float(c)) + (x - F.lit(float(a))) * F.lit(float(d - c)) / F.lit(float(b - a))


def identity(x: list[float]) -> list[float]:
    return x


# -- type 2 and 3 -------------------------------------------------------------------------------------


def exponential(c0: list[float], c1: list[float], n: float, domain: tuple[float, float] = (0.0, 1.0)) -> Function:
    """C0 + x**N (C1 - C0), missing components 0; only the domain clips."""
    size = max(len(c0), len(c1))
    a, b = c0 + [0.0] * (size - len(c0)), c1 + [0.0] * (size - len(c1))

    def run(x: list[float]) -> list[float]:
        t = clip(x[0] if x else 0.0, *domain) ** n
        return [p + t * (q - p) for p, q in zip(a, b, strict=True)]

    return run


def exponential_column(x: Column, c0: list[float], c1: list[float], n: float, domain: tuple[float, float] = (0.0, 1.0)) -> list[Column]:
    t = F.pow(clip_column(x, *domain), F.lit(float(n)))
    size = max(len(c0), len(c1))
    pad = lambda c: [float(v) for v in c] + [0.0] * (size - len(c))
    return [F.lit(p) + t * F.lit(q - p) for p, q in zip(pad(c0), pad(c1), strict=True)]


def stitching(parts: list[Function], bounds: list[float], encode: list[float], domain: tuple[float, float]) -> Function:
    """The part whose interval holds x; at a bound the one to the right."""
    edges = [domain[0], *bounds, domain[1]]

    def run(x: list[float]) -> list[float]:
        v = clip(x[0] if x else 0.0, *domain)
        k = sum(v >= b for b in bounds)
        low, high = encode[2 * k : 2 * k + 2] if len(encode) >= 2 * k + 2 else (0.0, 1.0)
        return parts[k]([interpolate(v, edges[k], edges[k + 1], low, high)])

    return run


def stitching_column(x: Column, parts: list[Callable[[Column], list[Column]]], bounds: list[float], encode: list[float], domain: tuple[float, float]) -> list[Column]:
    v, edges = clip_column(x, *domain), [domain[0], *bounds, domain[1]]
    results = [part(interpolate_column(v, edges[k], edges[k + 1], encode[2 * k], encode[2 * k + 1])) for k, part in enumerate(parts)]
    out = []
    for outputs in zip(*results, strict=True):
        chosen = outputs[-1]
        for k in range(len(bounds) - 1, -1, -1):
            chosen = F.when(v < F.lit(float(bounds[k])), outputs[k]).otherwise(chosen)
        out.append(chosen)
    return out


# -- type 0 -------------------------------------------------------------------------------------------


def unpack_bits(data: bytes, bits: int, count: int) -> np.ndarray:
    """count unsigned numbers of so many bits, high bits first; zeros beyond the data."""
    need = (count * bits + 7) // 8
    raw = np.unpackbits(np.frombuffer(data[:need].ljust(need, b"\0"), np.uint8))[: count * bits].reshape(count, bits)
    return raw.astype(np.float64) @ (2.0 ** np.arange(bits - 1, -1, -1))


def sampled(samples: np.ndarray, sizes: list[int], bits: int, domain: list[float], out_range: list[float], encode: list[float] | None = None, decode: list[float] | None = None) -> Function:
    """Multilinear interpolation between samples; the first input varies fastest."""
    m, n = len(sizes), len(out_range) // 2
    grid = samples[: int(np.prod(sizes)) * n].reshape(*reversed(sizes), n)
    encode = encode or [v for s in sizes for v in (0.0, s - 1.0)]
    decode = decode or out_range
    top = 2.0**bits - 1

    def run(x: list[float]) -> list[float]:
        lows, parts = [], []
        for i in range(m):
            v = clip(x[i] if i < len(x) else 0.0, domain[2 * i], domain[2 * i + 1])
            e = clip(interpolate(v, domain[2 * i], domain[2 * i + 1], encode[2 * i], encode[2 * i + 1]), 0.0, sizes[i] - 1.0)
            low = min(int(e), max(sizes[i] - 2, 0))
            lows.append(low)
            parts.append(e - low)
        total = np.zeros(n)
        for corner in range(1 << m):
            weight, place = 1.0, []
            for i in range(m):
                up = corner >> i & 1
                weight *= parts[i] if up else 1 - parts[i]
                place.append(min(lows[i] + up, sizes[i] - 1))
            if weight:
                total += weight * grid[tuple(reversed(place))]
        return [clip(interpolate(v, 0.0, top, decode[2 * j], decode[2 * j + 1]), out_range[2 * j], out_range[2 * j + 1]) for j, v in enumerate(total.tolist())]

    return run


def sampled_column(x: Column, samples: list[float], bits: int, domain: tuple[float, float], out_range: tuple[float, float], encode: tuple[float, float] | None = None, decode: tuple[float, float] | None = None) -> Column:
    """sampled() of one input and one output, as an expression."""
    last = len(samples) - 1
    e = clip_column(interpolate_column(clip_column(x, *domain), *domain, *(encode or (0.0, float(last)))), 0.0, float(last))
    low = F.least(F.floor(e), F.lit(max(last - 1, 0))).cast("int")
    grid = F.array(*map(F.lit, samples))
    value = F.get(grid, low) + (e - low) * (F.get(grid, F.least(low + 1, F.lit(last))) - F.get(grid, low))
    return clip_column(interpolate_column(value, 0.0, 2.0**bits - 1, *(decode or out_range)), *out_range)


# -- type 4 -------------------------------------------------------------------------------------------


def parse_program(data: bytes) -> list:
    """`{ ... }` as nested lists of numbers and words."""
    reader = Reader(data, content=True)
    if not reader.word(b"{"):
        raise Fault("function", "a program begins with a brace")

    def block() -> list:
        out = []
        while not reader.done():
            value = reader.value()
            if value == Token(b"{"):
                out.append(block())
            elif value == Token(b"}"):
                return out
            else:
                out.append(value.word.decode("latin-1") if isinstance(value, Token) else value)
        raise Fault("function", "a program doesn't end")

    return block()


def _angle(y: float, x: float) -> float:
    return math.degrees(math.atan2(y, x)) % 360


def _safe_pow(a: float, b: float) -> float:
    try:
        v = a**b
        return v if isinstance(v, float) and math.isfinite(v) else 0.0
    except (ZeroDivisionError, OverflowError):
        return 0.0


_BINARY = {
    "add": lambda a, b: a + b, "sub": lambda a, b: a - b, "mul": lambda a, b: a * b, "div": lambda a, b: a / b if b else 0.0,
    "idiv": lambda a, b: float(math.trunc(math.trunc(a) / math.trunc(b))) if math.trunc(b) else 0.0, "mod": lambda a, b: math.fmod(math.trunc(a), math.trunc(b)) if math.trunc(b) else 0.0,
    "atan": _angle, "exp": _safe_pow,
    "eq": lambda a, b: a == b, "ne": lambda a, b: a != b, "gt": lambda a, b: a > b, "ge": lambda a, b: a >= b, "lt": lambda a, b: a < b, "le": lambda a, b: a <= b,
}
_UNARY = {
    "neg": lambda a: -a, "abs": abs, "sqrt": lambda a: math.sqrt(max(a, 0.0)), "sin": lambda a: math.sin(math.radians(a)), "cos": lambda a: math.cos(math.radians(a)),
    "ln": lambda a: math.log(max(a, 1e-12)), "log": lambda a: math.log10(max(a, 1e-12)), "cvi": lambda a: float(math.trunc(a)), "truncate": lambda a: float(math.trunc(a)),
    "cvr": lambda a: a, "round": lambda a: math.copysign(math.floor(abs(a) + 0.5), a), "ceiling": lambda a: float(math.ceil(a)), "floor": lambda a: float(math.floor(a)),
}


def _number(v) -> float:
    return 0.0 if isinstance(v, bool) else float(v)


def _truth(v) -> bool:
    """A number counts as false."""
    return v if isinstance(v, bool) else False


def run_program(program: list, inputs: list[float], limit: int = 100_000) -> list:
    """The stack that is left. Unknown words are passed over; a short stack gives zeros."""
    stack: list = list(inputs)
    steps = 0

    def pop():
        return stack.pop() if stack else 0.0

    def run(block: list) -> None:
        nonlocal steps
        for i, word in enumerate(block):
            steps += 1
            if steps > limit:
                raise Fault("limit", "a program runs too long")
            if isinstance(word, list):
                continue  # taken by the if or ifelse that follows
            if isinstance(word, (int, float)) and not isinstance(word, bool):
                stack.append(float(word))
            elif isinstance(word, bool):
                stack.append(word)
            elif word in _BINARY:
                b, a = _number(pop()), _number(pop())
                stack.append(_BINARY[word](a, b))
            elif word in _UNARY:
                stack.append(_UNARY[word](_number(pop())))
            elif word in ("and", "or"):
                b, a = _truth(pop()), _truth(pop())
                stack.append((a and b) if word == "and" else (a or b))
            elif word == "not":
                stack.append(not _truth(pop()))
            elif word == "bitshift":
                n, v = int(_number(pop())), int(_number(pop()))
                stack.append(float(v << min(n, 64) if n >= 0 else v >> min(-n, 64)))
            elif word == "pop":
                pop()
            elif word == "exch":
                b, a = pop(), pop()
                stack.extend((b, a))
            elif word == "dup":
                stack.append(stack[-1] if stack else 0.0)
            elif word == "copy":
                n = int(_number(pop()))
                if 0 < n <= len(stack):
                    stack.extend(stack[-n:])
            elif word == "index":
                n = int(_number(pop()))
                stack.append(stack[-1 - n] if 0 <= n < len(stack) else 0.0)
            elif word == "roll":
                j, n = int(_number(pop())), int(_number(pop()))
                if 0 < n <= len(stack):
                    top = stack[-n:]
                    j %= n
                    stack[-n:] = top[-j:] + top[:-j] if j else top
            elif word == "if":
                if _truth(pop()) and i and isinstance(block[i - 1], list):
                    run(block[i - 1])
            elif word == "ifelse" and i > 1 and isinstance(block[i - 1], list) and isinstance(block[i - 2], list):
                run(block[i - 2] if _truth(pop()) else block[i - 1])

    run(program)
    return stack


def calculator(program: list, domain: list[float], out_range: list[float]) -> Function:
    """Clipped inputs on the stack; the topmost numbers, clipped, are the outputs; missing ones are zero."""
    n = len(out_range) // 2

    def run(x: list[float]) -> list[float]:
        inputs = [clip(x[i] if i < len(x) else 0.0, domain[2 * i], domain[2 * i + 1]) for i in range(len(domain) // 2)]
        left = [_number(v) for v in run_program(program, inputs)[-n:]]
        left = [0.0] * (n - len(left)) + left
        return [clip(v, out_range[2 * j], out_range[2 * j + 1]) for j, v in enumerate(left)]

    return run


def calculator_column(program: list, inputs: list[Column], domain: list[float], out_range: list[float]) -> list[Column]:
    """The program as Column expressions: the stack is worked off when planning, so the whole runs in generated code.

    Fault where a place on the stack isn't known when planning (copy, index or roll by a computed number).
    """
    zero = F.lit(0.0)

    def compile_block(block: list, stack: list[tuple[Column, str, float | None]]) -> list:
        """Of each entry: its Column, `n` or `b`, and its value if constant."""
        def pop():
            return stack.pop() if stack else (zero, "n", 0.0)

        def number(e):
            return e[0] if e[1] == "n" else zero

        def truth(e):
            return e[0] if e[1] == "b" else F.lit(False)

        def constant() -> int:
            e = pop()
            if e[2] is None:
                raise Fault("function", "a computed stack place can't be compiled")
            return int(e[2])

        trunc = lambda c: F.when(c < 0, F.ceil(c)).otherwise(F.floor(c)).cast("double")
        binary = {
            "add": lambda a, b: a + b, "sub": lambda a, b: a - b, "mul": lambda a, b: a * b, "div": lambda a, b: F.when(b == 0, zero).otherwise(F.try_divide(a, b)),
            "idiv": lambda a, b: F.when(trunc(b) == 0, zero).otherwise(trunc(F.try_divide(trunc(a), trunc(b)))), "mod": lambda a, b: F.when(trunc(b) == 0, zero).otherwise(F.try_mod(trunc(a), trunc(b))),
            "atan": lambda a, b: F.pmod(F.degrees(F.atan2(a, b)), F.lit(360.0)), "exp": lambda a, b: F.pow(a, b),
        }
        compare = {"eq": lambda a, b: a == b, "ne": lambda a, b: a != b, "gt": lambda a, b: a > b, "ge": lambda a, b: a >= b, "lt": lambda a, b: a < b, "le": lambda a, b: a <= b}
        unary = {
            "neg": lambda a: -a, "abs": F.abs, "sqrt": lambda a: F.sqrt(F.greatest(a, zero)), "sin": lambda a: F.sin(F.radians(a)), "cos": lambda a: F.cos(F.radians(a)),
            "ln": lambda a: F.log(F.greatest(a, F.lit(1e-12))), "log": lambda a: F.log10(F.greatest(a, F.lit(1e-12))), "cvi": trunc, "truncate": trunc, "cvr": lambda a: a,
            "round": lambda a: F.signum(a) * F.floor(F.abs(a) + 0.5), "ceiling": lambda a: F.ceil(a).cast("double"), "floor": lambda a: F.floor(a).cast("double"),
        }
        for i, word in enumerate(block):
            if isinstance(word, list):
                continue
            if isinstance(word, bool):
                stack.append((F.lit(word), "b", None))
            elif isinstance(word, (int, float)):
                stack.append((F.lit(float(word)), "n", float(word)))
            elif word in binary or word in compare:
                b, a = number(pop()), number(pop())
                stack.append((binary[word](a, b), "n", None) if word in binary else (compare[word](a, b), "b", None))
            elif word in unary:
                e = pop()
                value = -e[2] if word == "neg" and e[2] is not None else None
                stack.append((unary[word](number(e)), "n", value))
            elif word in ("and", "or"):
                b, a = truth(pop()), truth(pop())
                stack.append((a & b if word == "and" else a | b, "b", None))
            elif word == "not":
                stack.append((~truth(pop()), "b", None))
            elif word == "bitshift":
                n, v = constant(), trunc(number(pop())).cast("long")
                stack.append(((F.shiftleft(v, n) if n >= 0 else F.shiftright(v, -n)).cast("double"), "n", None))
            elif word == "pop":
                pop()
            elif word == "exch":
                b, a = pop(), pop()
                stack.extend((b, a))
            elif word == "dup":
                stack.append(stack[-1] if stack else (zero, "n", 0.0))
            elif word == "copy":
                n = constant()
                stack.extend(stack[-n:] if 0 < n <= len(stack) else [])
            elif word == "index":
                n = constant()
                stack.append(stack[-1 - n] if 0 <= n < len(stack) else (zero, "n", 0.0))
            elif word == "roll":
                j, n = constant(), constant()
                if 0 < n <= len(stack):
                    top, j = stack[-n:], j % n
                    stack[-n:] = top[-j:] + top[:-j] if j else top
            elif word in ("if", "ifelse"):
                test = truth(pop())
                yes = compile_block(block[i - 1] if word == "if" else block[i - 2], list(stack))
                no = list(stack) if word == "if" else compile_block(block[i - 1], list(stack))
                if len(yes) != len(no) or any(a[1] != b[1] for a, b in zip(yes, no, strict=True)):
                    raise Fault("function", "branches of different effect can't be compiled")
                stack[:] = [a if a is b else (F.when(test, a[0]).otherwise(b[0]), a[1], None) for a, b in zip(yes, no, strict=True)]
        return stack

    start = [(clip_column(x, domain[2 * i], domain[2 * i + 1]), "n", None) for i, x in enumerate(inputs)]
    n = len(out_range) // 2
    left = [e[0] if e[1] == "n" else zero for e in compile_block(program, start)[-n:]]
    left = [zero] * (n - len(left)) + left
    return [clip_column(c, out_range[2 * j], out_range[2 * j + 1]) for j, c in enumerate(left)]


# -- from objects -------------------------------------------------------------------------------------


def function_of(document, value, depth: int = 0) -> Function:
    """A function object, or an array of them whose outputs are put together."""
    value = document.resolve(value)
    if depth > 16:
        raise Fault("limit", "functions nested too deep")
    if value == "Identity":
        return identity
    if isinstance(value, list):
        parts = [function_of(document, v, depth + 1) for v in value]
        return lambda x: [y for part in parts for y in part(x)]
    entries = document.dictionary(value)
    floats = lambda key: [document.number(v) or 0.0 for v in document.array(entries.get(key))]
    kind, domain, out_range = document.resolve(entries.get("FunctionType")), floats("Domain") or [0.0, 1.0], floats("Range")
    if kind == 2:
        return exponential(floats("C0") or [0.0], floats("C1") or [1.0], document.number(entries.get("N")) or 0.0, tuple(domain[:2]))
    if kind == 3:
        parts = [function_of(document, v, depth + 1) for v in document.array(entries.get("Functions"))]
        if not parts:
            raise Fault("function", "nothing to stitch")
        return stitching(parts, floats("Bounds")[: len(parts) - 1], floats("Encode"), tuple(domain[:2]))
    if kind == 0 and isinstance(value, Stream) and out_range:
        sizes, bits = [max(int(v), 1) for v in floats("Size")], int(document.number(entries.get("BitsPerSample")) or 8)
        count = reduce(lambda a, b: a * b, sizes, 1) * (len(out_range) // 2)
        if count > 1 << 24:
            raise Fault("limit", "too many samples")
        return sampled(unpack_bits(document.decoded(value), bits, count), sizes, bits, domain, out_range, floats("Encode") or None, floats("Decode") or None)
    if kind == 4 and isinstance(value, Stream) and out_range:
        return calculator(parse_program(document.decoded(value)), domain, out_range)
    raise Fault("unsupportedFeature", f"function type {kind}")
