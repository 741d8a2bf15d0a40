"""Connected components of links between documents, as the library finds them."""

from agestrata.functions.components import components as components
