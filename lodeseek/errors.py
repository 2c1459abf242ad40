"""What can go wrong, by kind."""


class SearchError(Exception):
    """Base of the library's own errors."""


class IndexAlreadyExistsError(SearchError):
    pass


class IndexNotFoundError(SearchError):
    pass


class SchemaMismatchError(SearchError):
    pass


class WriterAlreadyOpenError(SearchError):
    pass


class AlreadyClosedError(SearchError):
    pass


class CloseError(SearchError):
    """Several things failed while closing; they are in errors."""

    def __init__(self, errors: tuple[BaseException, ...]):
        super().__init__("; ".join(map(str, errors)))
        self.errors = errors


class TooManyTermsError(SearchError, ValueError):
    """A prefix stands for more terms than allowed; it is never cut short."""

    def __init__(self, field: str, prefix: str, limit: int):
        super().__init__(f"{field}:{prefix}* has more than {limit} terms")
        self.field, self.prefix, self.limit = field, prefix, limit


class SchemaError(ValueError):
    """A schema or a document breaks the rules."""


class QueryError(ValueError):
    """A query object that can't be."""


class CorruptIndexError(ValueError):
    """A segment's files aren't what was written."""


class QuerySyntaxError(ValueError):
    """A query text that can't be read, with the place."""

    def __init__(self, message: str, offset: int, source: str):
        super().__init__(f"{message} at offset {offset}\n{source}\n{' ' * offset}^")
        self.message, self.offset, self.source = message, offset, source
