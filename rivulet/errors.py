"""Errors of the SQL front end; each has a status code as a response carries it."""

from __future__ import annotations


class RivuletError(Exception):
    code = 500


class ParseError(RivuletError):
    """Text that is no statement."""

    code = 400


class PlanError(RivuletError):
    """A statement that breaks a rule of the dialect."""

    code = 400


class NotFound(RivuletError):
    code = 404


class AlreadyExists(RivuletError):
    code = 409
