"""Tables written to the folder that driver and executors share: see ``pulsegrid.scratch``."""

from ..scratch import at_most, bucketed, drop, folder, lean, release, written

__all__ = ["at_most", "bucketed", "drop", "folder", "lean", "release", "written"]
