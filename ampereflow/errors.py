"""The four failures that callers tell apart."""


class ApplicationError(Exception):
    """A failure whose text is constant and never quotes data."""

    code = "application_error"


class InvalidRequestError(ApplicationError):
    code = "invalid_request"


class NotFoundError(ApplicationError):
    code = "not_found"


class ConflictError(ApplicationError):
    code = "conflict"


class DependencyUnavailableError(ApplicationError):
    code = "dependency_unavailable"
