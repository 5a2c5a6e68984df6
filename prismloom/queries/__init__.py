"""Named queries of the library."""


def registries() -> list:
    from .core import core
    from .extras import extras
    from .general import general
    from .pipelines import pipelines
    from .samples import samples

    return [core, pipelines, extras, samples, general]
