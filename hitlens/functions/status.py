"""Outcome status codes of the reference's request handling."""

# Fixed values.
OK = 200
ACCEPTED = 202
BAD_REQUEST = 400
NOT_FOUND = 404

# The reference's error texts.
BAD_UUID = "The id that has been searched is not a valid UUID"
EMAIL_ALREADY_EXISTS = "There is another user with the same email"
