"""The queries of the engine by name, and their SQL."""

from __future__ import annotations

from . import assembly, corpus, detection, extra, formats, frames, masks, more, normal, routing, scoring, shapes, stencils, streams

FLAGSHIP = "det_prf1_multi_iou"
MODULES = (detection, scoring, corpus, shapes, extra, more, streams, assembly, masks, routing, normal, stencils, frames, formats)
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in MODULES for k, v in m.ORACLES.items()}
