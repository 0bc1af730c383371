"""The registered queries, by subject. Importing this package registers them."""

from . import bi, cep, decisions, evidence, graph, mining, monitoring, retrieval, sources, tensors, text  # noqa: F401
