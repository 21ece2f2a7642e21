"""Functions in Java, beside this file as source: compiled by the compiler that Spark has for its own code, sent to the executors."""

from __future__ import annotations

import io
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql.types import _parse_datatype_string

from corpusatlas.storage import fresh_dir

_THERE: set[tuple[str, str]] = set()


def register(spark: SparkSession, name: str, result: str) -> str:
    """The SQL name of the session's function from NAME.java, whose values have the type `result`."""
    jvm, gateway, session = spark._jvm, spark.sparkContext._gateway, spark._jsparkSession
    at = jvm.java.lang.Thread.currentThread()
    if (key := (session.sessionUUID(), name)) not in _THERE:
        compiler = jvm.org.codehaus.janino.SimpleCompiler()
        compiler.setParentClassLoader(at.getContextClassLoader())
        compiler.cook((Path(__file__).parent / f"{name}.java").read_text())
        classes, jar = compiler.getBytecodes(), io.BytesIO()
        with zipfile.ZipFile(jar, "w") as z:
            for c in list(classes.keySet()):
                z.writestr(c.replace(".", "/") + ".class", bytes(classes.get(c)))
        path = jvm.org.apache.hadoop.fs.Path(f"{fresh_dir(spark, name)}.jar")
        out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
        out.write(bytearray(jar.getvalue()))
        out.close()
        spark.sql(f"ADD JAR '{path.toString()}'")
        made = at.getContextClassLoader().loadClass(f"corpusatlas.{name}").getDeclaredConstructor(gateway.new_array(jvm.java.lang.Class, 0))
        session.udf().register(name, made.newInstance(gateway.new_array(jvm.java.lang.Object, 0)), session.parseDataType(_parse_datatype_string(result).json()))
        _THERE.add(key)
    return name
