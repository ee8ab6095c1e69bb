"""Values and helpers that the tests of the library share."""

SF_SMALL = "/root/testdata/sf0.001"


def write(path, text, encoding="utf-8", newline=None):
    with open(path, "w", encoding=encoding, newline=newline) as f:
        f.write(text)
    return path
