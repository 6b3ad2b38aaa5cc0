"""Errors of the dialect."""


class QueryError(Exception):
    """A query that can't be parsed, resolved or typed."""


class ParseError(QueryError):
    pass
