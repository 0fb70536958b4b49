"""Java functions, from the sources beside this file.

The compiler is the one by which Spark compiles its plans, so there is nothing to install or to build; executors get the
classes as a jar of the session."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import warnings
import weakref
import zipfile
from importlib import resources

from pyspark.sql import SparkSession
from pyspark.sql.types import DataType

_known: weakref.WeakKeyDictionary[SparkSession, dict[str, str | None]] = weakref.WeakKeyDictionary()


def _registered(spark: SparkSession, name: str, returns: DataType) -> str:
    jvm, session = spark._jvm, spark._jsparkSession
    compiler = jvm.org.codehaus.janino.SimpleCompiler()
    compiler.cook((resources.files("refsift.functions") / f"{name}.java").read_text())
    classes = compiler.getBytecodes()
    folder = os.path.realpath(tempfile.mkdtemp(prefix="refsift-"))
    atexit.register(shutil.rmtree, folder, True)
    with zipfile.ZipFile(os.path.join(folder, f"{name}.jar"), "w") as jar:
        for k in classes:
            jar.writestr(f"{k.replace('.', '/')}.class", bytes(classes[k]))
    spark.sql(f"ADD JAR '{folder}/{name}.jar'")
    none = jvm.java.util.ArrayList()
    made = session.artifactManager().classloader().loadClass(f"refsift.{name}")
    made = made.getConstructor(spark.sparkContext._gateway.new_array(jvm.java.lang.Class, 0)).newInstance(none.toArray())
    called = f"refsift_{name.lower()}"
    session.udf().register(called, made, session.parseDataType(returns.json()))
    return called


def function(spark: SparkSession, name: str, returns: DataType) -> str | None:
    """The SQL name of a function; None, with a warning, where this session can't take it."""
    known = _known.setdefault(spark, {})
    if name not in known:
        try:
            known[name] = _registered(spark, name, returns)
        except Exception as e:  # noqa: BLE001  whatever the gateway raises
            warnings.warn(f"{name}.java is not used, the same is done in Python, slowly: {e}", stacklevel=2)
            known[name] = None
    return known[name]
