"""What can go wrong, by kind."""


class GraphError(Exception):
    """Base of all errors of the library."""


class NotFound(GraphError):
    pass


class Conflict(GraphError):
    pass


class InvalidQuery(GraphError):
    pass


class CapacityExceeded(GraphError):
    pass


class SchemaViolation(GraphError):
    pass


class DimensionMismatch(GraphError):
    pass


class NotAllowed(GraphError):
    pass
