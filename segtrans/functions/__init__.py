from . import files, langs, style, text  # noqa: F401
