"""DataFrame operators.

Rules kept throughout:

* a group may hold a third of all rows, so groups are reduced by partial aggregation and never
  gathered whole in one task; where a rank inside a group is needed it is cut by value first;
* nothing is broadcast by hint unless its row count is fixed by construction; everything else is left to
  the planner's own size checks, before and while a query runs;
* ties are broken by a total order, so results do not depend on partitioning.
"""
