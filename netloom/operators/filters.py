"""The packet-filter language, compiled to one boolean column.

``or`` binds weaker than ``and``, which binds weaker than ``not``; all associate to the
left. Tokens are separated by white space and parentheses; there is no quoting.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C


@dataclass
class FilterError(ValueError):
    """Why an expression could not be read; subclasses say which."""

    got: str | int | None = None

    def __str__(self) -> str:
        return f"{type(self).__name__}({'' if self.got is None else self.got})"


class MissingRightParen(FilterError):
    pass


class ExpectedRightParen(FilterError):
    pass


class UnexpectedEnd(FilterError):
    pass


class ExpectedDigit(FilterError):
    pass


class PortOutOfRange(FilterError):
    pass


class UnknownToken(FilterError):
    pass


class MissingArgument(FilterError):
    pass


class ExtraToken(FilterError):
    pass


PROTOCOLS = {p.lower(): p for p in (C.TCP, C.UDP, C.DNS, C.HTTP, C.TLS, C.QUIC, C.ICMP, C.ICMPV6, C.IPV4, C.IPV6, C.ETHERNET)}


def _holds(column: str, needle: str) -> Column:
    return F.contains(F.lower(F.col(column)), F.lit(needle.lower()))


def _port(argument: str) -> Column:
    try:
        number = int(argument) if argument.lstrip("+-").isascii() and argument.lstrip("+-").isdigit() else None
    except ValueError:
        number = None
    if number is None or not -(2**31) <= number < 2**31:
        raise ExpectedDigit(argument)
    if not 0 <= number <= 65535:
        raise PortOutOfRange(number)
    return (F.col("src_port") == number) | (F.col("dst_port") == number)


def _text(needle: str) -> Column:
    wanted = needle.encode("utf-8").decode("latin-1").lower()
    return F.contains(F.lower(F.decode("data", "ISO-8859-1")), F.lit(wanted))


def _url(needle: str) -> Column:
    whole = F.concat(F.coalesce("http_host", F.lit("")), F.coalesce("http_path", F.lit("")))
    return F.contains(F.lower(whole), F.lit(needle.lower())) | F.coalesce(_holds("sni", needle), F.lit(False))


ATOMS: dict[str, Callable[[str], Column]] = {
    "host": lambda a: (F.col("src_ip") == a) | (F.col("dst_ip") == a),
    "port": _port,
    "sni": lambda a: _holds("sni", a),
    "http.host": lambda a: _holds("http_host", a),
    "http.path": lambda a: _holds("http_path", a),
    "http.method": lambda a: F.upper("http_method") == a.upper(),
    "url": _url,
    "dns.name": lambda a: F.exists("dns_names", lambda x: F.contains(F.lower(x), F.lit(a.lower()))),
    "app": lambda a: _holds("app_name", a),
    "text": _text,
}


def _in_tree(test: Callable[[Column], Column]) -> Column:
    return F.exists("layers", test)


def _field_of(protocols: tuple[str, ...], names: tuple[str, ...], test: Callable[[Column], Column], inside: str | None = None) -> Column:
    """Whether a layer of the protocols has a field (or, with ``inside``, a child of that field)
    of one of the names whose value passes."""

    def own(fields: Column) -> Column:
        return F.exists(fields, lambda f: F.lower(f["name"]).isin(*names) & F.coalesce(test(f["value"]), F.lit(False)))

    def layer(x: Column) -> Column:
        fields = x["fields"]
        found = own(fields) if inside is None else F.exists(fields, lambda f: (F.lower(f["name"]).rlike(f"^(?:{inside})$")) & own(f["children"]))
        return x["protocol"].isin(*protocols) & found

    return _in_tree(layer)


def _has(needle: str) -> Callable[[Column], Column]:
    return lambda value: F.contains(F.lower(value), F.lit(needle.lower()))


def _request(test: Callable[[Column], Column]) -> Column:
    return _field_of((C.HTTP,), ("request line",), test)


def _tree_url(needle: str) -> Column:
    def whole(x: Column) -> Column:
        def first(name: str) -> Column:
            return F.try_element_at(F.filter(x["fields"], lambda f: F.lower(f["name"]) == name), F.lit(1))["value"]

        path = F.try_element_at(F.split(first("request line"), " "), F.lit(2))
        return (x["protocol"] == C.HTTP) & _has(needle)(F.concat(F.coalesce(first("host"), F.lit("")), F.coalesce(path, F.lit(""))))

    return _in_tree(whole) | TREE_ATOMS["sni"](needle)


def _tree_port(argument: str) -> Column:
    _port(argument)  # the same errors
    return _field_of((C.TCP, C.UDP), ("source port", "destination port"), lambda value: value == str(int(argument)))


#: The same atoms, answered from the protocol tree instead of the flat columns.
TREE_ATOMS: dict[str, Callable[[str], Column]] = {
    "host": lambda a: _field_of((C.IPV4, C.IPV6), ("source", "destination"), lambda value: value == a),
    "port": _tree_port,
    "sni": lambda a: _field_of((C.TLS,), ("server name indication",), _has(a), inside="handshake"),
    "http.host": lambda a: _field_of((C.HTTP,), ("host",), _has(a)),
    "http.path": lambda a: _request(lambda v: _has(a)(F.try_element_at(F.split(v, " "), F.lit(2)))),
    "http.method": lambda a: _request(lambda v: F.upper(F.try_element_at(F.split(v, " "), F.lit(1))) == a.upper()),
    "url": _tree_url,
    "dns.name": lambda a: _field_of((C.DNS,), ("name",), _has(a), inside="query|answer"),
    "app": lambda a: _field_of((C.APP_METADATA,), ("app name",), _has(a)),
    "text": _text,
}


class _Parser:
    def __init__(self, text: str, tree: bool = False) -> None:
        self.tree = tree
        self.atoms = TREE_ATOMS if tree else ATOMS
        self.tokens = text.replace("(", " ( ").replace(")", " ) ").split()
        self.at = 0

    def peek(self) -> str | None:
        return self.tokens[self.at] if self.at < len(self.tokens) else None

    def take(self) -> str | None:
        token = self.peek()
        self.at += token is not None
        return token

    def chain(self, word: str, part: Callable[[], Column], join: Callable[[Column, Column], Column]) -> Column:
        left = part()
        while (self.peek() or "").lower() == word:
            self.take()
            left = join(left, part())
        return left

    def either(self) -> Column:
        return self.chain("or", self.both, lambda a, b: a | b)

    def both(self) -> Column:
        return self.chain("and", self.one, lambda a, b: a & b)

    def one(self) -> Column:
        token = (self.peek() or "").lower()
        if token == "not":
            self.take()
            return ~self.one()
        if token != "(":
            return self.atom()
        self.take()
        inner, close = self.either(), self.take()
        if close is None:
            raise MissingRightParen
        if close != ")":
            raise ExpectedRightParen(close)
        return inner

    def atom(self) -> Column:
        token = self.take()
        if token is None:
            raise UnexpectedEnd
        key = token.lower()
        if key in PROTOCOLS:
            name = PROTOCOLS[key]
            return _in_tree(lambda x: x["protocol"] == name) if self.tree else F.array_contains("protocols", name)
        if key not in self.atoms:
            raise UnknownToken(token)
        argument = self.take()
        if argument is None:
            raise MissingArgument(key)
        # A predicate on an absent value is false, so that its negation holds.
        return F.coalesce(self.atoms[key](argument), F.lit(False))


def match_filter(text: str, tree: bool = False, on_error: str = "raise") -> Column:
    """The expression as a column over ``frames()``; blank matches everything. Errors are
    raised here, before any job; with ``on_error="match_all"`` an unreadable expression
    matches everything. With ``tree`` it reads the column ``layers`` of
    ``with_layers`` instead of the flat columns, with the same answer."""
    try:
        return _read(_Parser(text, tree))
    except FilterError:
        if on_error != "match_all":
            raise
        return F.lit(True)


def _read(parser: _Parser) -> Column:
    if not parser.tokens:
        return F.lit(True)
    found = parser.either()
    if parser.peek() is not None:
        raise ExtraToken(parser.peek())
    return found


class _IndexParser(_Parser):
    """Reads an expression as a necessary condition on a stretch of a capture: what an index does
    not know, and whatever is negated, may always be there."""

    def one(self) -> Column:
        if (self.peek() or "").lower() != "not":
            return super().one()
        super().one()
        return F.lit(True)

    def atom(self) -> Column:
        word, argument = (self.peek() or "").lower(), (self.tokens[self.at + 1] if self.at + 1 < len(self.tokens) else "")
        super().atom()  # the same errors
        from ..sources.pcap_index import may_hold

        if word == "host":
            return may_hold(f"address {argument}")
        return may_hold(f"port {int(argument)}") if word == "port" else F.lit(True)


def index_filter(text: str) -> Column:
    """The expression as a column over an index of captures (``sources.pcap_index``), false only
    for stretches without a match."""
    return _read(_IndexParser(text))


def filter_frames(frames: DataFrame, text: str, on_error: str = "raise") -> DataFrame:
    """The packets that match. With ``on_error="match_all"`` an unreadable expression
    matches everything."""
    return frames.where(match_filter(text, on_error=on_error))
