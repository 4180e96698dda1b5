"""Analyst verbs over a graph's projection: rank, cluster, similar, paths, analyze."""

from sparkloom.algo.verbs import ANALYZE as ANALYZE
from sparkloom.algo.verbs import CLUSTER as CLUSTER
from sparkloom.algo.verbs import PATHS as PATHS
from sparkloom.algo.verbs import RANK as RANK
from sparkloom.algo.verbs import SIMILAR as SIMILAR
from sparkloom.algo.verbs import analyze as analyze
from sparkloom.algo.verbs import cluster as cluster
from sparkloom.algo.verbs import paths as paths
from sparkloom.algo.verbs import rank as rank
from sparkloom.algo.verbs import similar as similar
from sparkloom.algo.verbs import write_property as write_property
