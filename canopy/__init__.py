"""canopy: DataFrame operators for corpora of UI trees and the records around them."""
