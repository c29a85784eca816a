"""Errors carry a code, a status and details."""


class SearchError(Exception):
    def __init__(self, code: str, message: str, status: int = 400, **details):
        super().__init__(message)
        self.code, self.status, self.details = code, status, details

    def as_dict(self) -> dict:
        return {"error": {"code": self.code, "message": str(self), **self.details}}
