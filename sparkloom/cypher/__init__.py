"""The query language: text to DataFrame plans."""

from sparkloom.cypher.lower import execute as execute
from sparkloom.cypher.writing import run as run
